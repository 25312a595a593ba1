"""The training-data queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, exact_dedup, line_crf, mixing, near_dedup, quality_rules, substring_dedup, suffix_dedup, token_files, word_lm

QUERIES = {"pipeline": corpus_pipeline.run, "op1_suffix_dedup": suffix_dedup.op1, "op2_exact_dedup": exact_dedup.op2, "op3_mix_sources": mixing.op3, "op4_quality_rules": quality_rules.op4, "op5_near_dedup": near_dedup.op5, "op6_bpe": bpe.op6, "op7_line_crf": line_crf.op7, "op8_word_lm": word_lm.op8, "op9_token_files": token_files.op9, "op10_substring_dedup": substring_dedup.op10}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE, "op3_mix_sources": mixing.ORACLE}

"""A training-data pipeline over ``documents``: quality rules, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last return the
columns of documents. Decisions go by doc_id: rows that share one (null included) stay if any of them stays. Identical
rows of one doc_id stay together. Nulls, empty and very long texts and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_digests
from tessera.llm.common import fresh, materialize, small
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import copies, mix_sources
from tessera.llm.near_dedup import near_dedup
from tessera.llm.quality_rules import rules

#: A file of the tokenizers library; None: the public word-level BPE of 49k entries.
TOKENIZER: str | None = None


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the ids that no decided row keeps: few ids, broadcast if their table is small enough."""
    name = fresh(docs, "_gone")
    gone = decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias(name))
    gone, n_bytes = materialize(gone, "rejected")
    return docs.join(small(gone, n_bytes), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, rules(docs).select("doc_id", "kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, exact_dedup(docs).select("doc_id", "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, near_dedup(docs).select("doc_id", "kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return copies(docs, mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode_digests(docs, path, with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("encode", encode)]

#: Perplexity bands, sketches and merges have no SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Every text is normalised (white space deleted) and cut into chunks at places its own content defines. A chunk's identifier
is 128 bits of hash, verified: a dictionary of distinct (identifier, content) pairs shows that no identifier stands for two
contents. A document is then an ordered list of identifiers, its recipe, and only recipes are grouped and joined; the long
text is read where it lies and never moves with its document. If an identifier ever stood for two contents, recipes
of the chunk contents themselves are used instead, so the outcome is exact in any case.

Edge cases: null and empty texts normalise to the empty text and form one group with an empty recipe. A null doc_id counts
as larger than any other. Of rows that share a doc_id but differ in white space only those with the most code points are
kept; rows that also agree in that are counted one by one and all marked kept when their doc_id is the one that stays. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import heavy_join, materialize

#: Chunks of 1024 to 8192 characters that end after a sentence mark; a text's last chunk may be shorter.
CHUNKS = r"(?s).{1024,8192}?(?:[.!?;:]|\z)|.{1,8192}"


def normalized(text: F.Column) -> F.Column:
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\v", "\f"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_cp, text_sha256, recipe) for each document, and the distinct (a, b, chunk) dictionary."""
    norm = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), normalized(F.col(text_col)).alias("_norm"))
    cut = norm.select("*", F.regexp_extract_all("_norm", F.lit(CHUNKS), F.lit(0)).alias("_chunks"))
    lists = cut.select(
        "doc_id",
        "n_cp",
        F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"),
        F.transform("_chunks", lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))).alias("recipe"),
    )
    chunk = cut.select(F.explode("_chunks").alias("chunk")).select(F.xxhash64("chunk").alias("a"), F.xxhash64(F.lit(1), F.col("chunk")).alias("b"), "chunk").distinct()
    return lists, chunk


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    lists, chunk = recipes(docs, id_col, text_col)
    if chunk.groupBy("a", "b").count().filter("count > 1").limit(1).count():
        cut = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), normalized(F.col(text_col)).alias("_norm"))
        lists = cut.select("doc_id", "n_cp", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), F.regexp_extract_all("_norm", F.lit(CHUNKS), F.lit(0)).alias("recipe"))
    lists, _ = materialize(lists, "recipes")
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))).alias("best")
    groups = lists.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best).select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_cp"))
    groups, _ = materialize(groups, "recipe-groups")
    out = heavy_join(lists, groups, ["recipe"], lists.count(), "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).alias("kept"), "text_sha256")


ORACLE = r"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AND n_cp = first_value(n_cp) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
"""


def op2(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Keys are uniform, so their leading bits cut every source into ranges of like
size, however large the source: documents are sorted within a range, prefix sums of sizes within a range are added to prefix
sums over the ranges, and each source is cut at its budget. A budget over the source's size takes whole epochs first.

Targets: sources by code point, null last, have weights 1, 2, 3, 1, ... and share the total size; a target
stops at ``cap`` times its source's size, and the excess is shared again by weight. In the order of cap/weight the sources
that stop are a prefix, so with R the total less the caps before a source and W the weights from it on, the final level is
the largest R/W and each target is min(cap, weight * level): no iteration.

A document is taken whole: it belongs to the last, partial epoch if its middle lies within the budget's remainder, so a
source's taken words differ from its target by half a document at most. Edge cases: null and empty texts have size 0 and
are never taken; null sources are one source; keys come from doc_id (null too) and text, so rows that share one of them are
spread; equal rows have equal keys and are taken one after the other; a total of 0 gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import fresh, materialize, small

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in one range of keys, about.
RANGE_ROWS = 1024


def sizes(docs: DataFrame, seed: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.encode(text, "UTF-8"))).cast("binary"))
    return docs.select("doc_id", "source", key.alias("_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("size"))


def targets(by_source: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """(source, source_size) with weight and target; one row per source."""
    every = W.partitionBy(F.lit(0))
    w = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1
    d = by_source.withColumn("weight", w.cast("long")).withColumn("_cap", cap * F.col("source_size"))
    up = every.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    d = d.withColumn("_level", (F.sum("source_size").over(every) - before).cast("double") / left.cast("double"))
    return d.select("source", "source_size", "weight", F.least(F.col("_cap").cast("double"), F.col("weight").cast("double") * F.max("_level").over(every)).alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", cap: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (a multiple of size, at most cap times it)."""
    sized, _ = materialize(sizes(docs, seed), "mix-sizes")
    bits = max(0, (sized.count() // RANGE_ROWS)).bit_length()
    lead = F.conv(F.substring(F.col("_key"), 1, 8), 16, 10).cast("long")
    keyed = sized.select("*", F.shiftright(lead, 32 - bits).cast("int").alias("_range") if bits else F.lit(0).alias("_range"), F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_no"))
    held = ["_no", "_s", "_range"]
    sums = keyed.groupBy(*held).agg(F.sum("size").alias("n"))
    sums, n_bytes = materialize(sums.select("*", F.coalesce(F.sum("n").over(W.partitionBy("_no", "_s").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base")), "mix-ranges")
    by_source = sums.groupBy("_no", "_s").agg(F.sum("n").alias("source_size")).select(F.when(~F.col("_no"), F.col("_s")).alias("source"), "source_size")
    goal = targets(by_source, cap).select(F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_s"), "source_size", "target")
    base = sums.select(*held, "_base").join(goal, ["_no", "_s"])
    inside = F.coalesce(F.sum("size").over(W.partitionBy(*held).orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = keyed.withColumn("_in", inside).join(small(base, n_bytes), held)
    full = F.when(F.col("source_size") > 0, F.least(F.lit(cap).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    rest = F.col("target") - (F.col("_full") * F.col("source_size")).cast("double")
    fits = (F.col("_full") < cap) & ((2 * (F.col("_base") + F.col("_in")) + F.col("size")).cast("double") <= 2 * rest)
    d = d.withColumn("_full", full).withColumn("taken", F.col("size") * (F.col("_full") + F.when(fits, 1).otherwise(0)))
    return d.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
      FROM w WINDOW u AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * max(lev) OVER ()) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(3, CAST(floor(t.target / t.source_size) AS BIGINT)) ELSE 0 END AS e,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (e + CASE WHEN e < 3 AND CAST(2 * before + size AS DOUBLE) <= 2 * (target - CAST(e * source_size AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op3(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    own, n, copy = (fresh(docs, c) for c in ("_id", "_times", "_copy"))
    times = mixed.filter("taken > 0").select(F.col("doc_id").alias(own), (F.col("taken") / F.col("size")).cast("int").alias(n))
    times = times.groupBy(own).agg(F.max(n).alias(n))  # rows that share an id are taken as often as the one taken most
    times, n_bytes = materialize(times, "mix-times")
    out = docs.join(small(times, n_bytes), F.col("doc_id").eqNullSafe(F.col(own)))
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)

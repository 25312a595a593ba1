"""Datasets as one virtual row range: offsets, and slices of the range resolved to slices of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def offsets(sizes: DataFrame, dataset: str = "dataset_id", n: str = "n_rows") -> DataFrame:
    """start and stop of each dataset in the virtual range: running sums over one row a dataset."""
    w = W.partitionBy(F.lit(0)).orderBy(dataset)
    stop = F.sum(n).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long")
    return sizes.select("*", stop.alias("stop")).withColumn("start", (F.col("stop") - F.col(n)).cast("long"))


def virtual_rows(rows: DataFrame, dataset: str = "dataset_id", position: str = "pos", name: str = "obs_id") -> DataFrame:
    """rows with their place in the virtual range; the offsets, one row a dataset, are broadcast."""
    at = offsets(rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"))).select(dataset, F.col("start").alias("_start"))
    return rows.join(F.broadcast(at), dataset).withColumn(name, (F.col("_start") + F.col(position)).cast("long")).drop("_start")


def resolve(slices: DataFrame, datasets: DataFrame) -> DataFrame:
    """slices (pos, start, stop) cut at dataset borders: pos, dataset_id, rel_start, rel_stop.

    Both sides are plan-sized: datasets (one row each) are broadcast and each slice finds its first and last.
    """
    d = datasets.select("dataset_id", F.col("start").alias("_a"), F.col("stop").alias("_b"))
    hit = slices.join(F.broadcast(d), (F.col("start") < F.col("_b")) & (F.col("stop") > F.col("_a")))
    return hit.select("pos", "dataset_id", (F.greatest("start", "_a") - F.col("_a")).alias("rel_start"), (F.least("stop", "_b") - F.col("_a")).alias("rel_stop"))

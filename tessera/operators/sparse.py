"""Sparse rows: built from (row, feature, value) items, and their row pointers when a CSR matrix is wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def rows_from_items(items: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """row, x: items of a row and feature add up (before the shuffle too); indices ascend."""
    total = items.groupBy(row, feature).agg(F.sum(value).alias("_v"))
    sorted_ = total.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).cast("int").alias("i"), F.col("_v").alias("v")))).alias("_e"))
    x = F.struct(F.transform("_e", lambda e: e["i"]).alias("indices"), F.transform("_e", lambda e: e["v"]).alias("values"))
    return sorted_.select(row, x.alias("x"))


def with_empty_rows(obs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """obs joined with its sparse rows; a row without items is an empty one, not a null."""
    kind = rows.schema["x"].dataType
    empty = F.struct(F.array().cast(kind["indices"].dataType).alias("indices"), F.array().cast(kind["values"].dataType).alias("values"))
    return obs.join(rows, key, "left").withColumn("x", F.coalesce("x", empty))


def indptr(rows: DataFrame, group: str, position: str) -> DataFrame:
    """group, position, ptr_start, ptr_stop: running element counts within each group (a dataset or request)."""
    w = W.partitionBy(group).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.size(F.col("x")["indices"]).cast("long")
    stop = F.sum(n).over(w)
    return rows.select(group, position, (stop - n).alias("ptr_start"), stop.alias("ptr_stop"))

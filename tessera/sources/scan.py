"""Scans: stored matrices as lazy DataFrames whose rows have a dense order, without a shuffle."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.categories import categories, union_categories, with_categories
from tessera.types import Annotated

#: Files whose offsets may be broadcast.
BROADCAST_FILES = 1_000_000

Load = Callable[[SparkSession, str], Annotated]


def fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    f, p = fs(spark, path)
    return f.exists(p)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where that is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {spark.sparkContext.master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _states(spark: SparkSession, folder: str, stem: str) -> list[tuple[int, str]]:
    f, p = fs(spark, folder)
    if not f.exists(p):
        return []
    names = [(re.fullmatch(rf"{stem}-(\d+)\.json", x.getPath().getName()), x.getPath().toString()) for x in f.listStatus(p)]
    return sorted((int(m[1]), at) for m, at in names if m)


def read_state(spark: SparkSession, folder: str, stem: str):
    """The newest state of a folder, None if it has none."""
    states = _states(spark, folder, stem)
    if not states:
        return None
    f, p = fs(spark, states[-1][1])
    stream = f.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def write_state(spark: SparkSession, folder: str, stem: str, value) -> None:
    """Written aside and renamed to a number that is not taken; the states before go only then. So at every moment a reader finds
    the old state or the new one, whole, also after a crash between any two of these steps."""
    states = _states(spark, folder, stem)
    number = states[-1][0] + 1 if states else 1
    f, p = fs(spark, f"{folder}/{stem}-{number:08d}.json")
    _, aside = fs(spark, f"{folder}/{stem}-{number:08d}.{uuid.uuid4().hex}.new")
    stream = f.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    if f.exists(p) or not f.rename(aside, p):
        f.delete(aside, False)
        raise OSError(f"another writer has changed {folder}")
    for _, old in states:
        f.delete(fs(spark, old)[1], False)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df, a Parquet scan, with dense row numbers in the order of file names and rows.

    A file's offset is the sum of the row counts before it (one row a file, broadcast up to BROADCAST_FILES of them); the rest is
    the reader's own row index: no shuffle.
    """
    few = len(df.inputFiles()) <= BROADCAST_FILES
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    count = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    base = count.select("_file", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return at.join(F.broadcast(base) if few else base, "_file").withColumn(name, F.col("_base") + F.col("_row")).drop("_file", "_row", "_base")


def default_load(spark: SparkSession, path: str) -> Annotated:
    """``<path>/rows`` and ``<path>/var`` if there, else path itself as a table of rows. Lazy; Catalyst prunes what is unused."""
    inner = exists(spark, f"{path}/rows")
    rows = with_row_ids(spark.read.parquet(f"{path}/rows" if inner else path))
    var = spark.read.parquet(f"{path}/var").select("var_id", "var_name") if exists(spark, f"{path}/var") else None
    return Annotated(rows, var, ["row_id"])


def write_source(data: Annotated, path: str) -> None:
    """Stores a matrix for ``default_load``; rows keep the order of data.order."""
    rows = data.rows.sort(*data.order).drop(*data.order) if data.order else data.rows
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    if data.var is not None:
        data.var.coalesce(1).write.mode("overwrite").parquet(f"{path}/var")


def name_of(path: str) -> str:
    return str(PurePosixPath(path))


def concat_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Row concatenation by column name; a column absent from a part is null there. Categories are united over all parts."""
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in out.columns:
        known = [k for p in parts if c in p.columns and (k := categories(p, c))]
        if known:
            out = with_categories(out, c, union_categories(known))
    return out


def numbered(data: Annotated, scratch: str) -> Annotated:
    """data with dense ``row_id`` by its order columns: sorted by ranges into a scratch table, whose row indexes are the numbers."""
    if data.order == ["row_id"]:
        return data
    if not data.order:
        raise ValueError("rows without an order column")
    spark = data.rows.sparkSession
    data.rows.sort(*data.order).write.mode("overwrite").parquet(scratch)
    back = spark.read.schema(data.rows.schema).parquet(scratch)
    return Annotated(with_row_ids(back).drop(*(c for c in data.order if c.startswith("_"))), data.var, ["row_id"])


def scan_sources(parts: Sequence[Annotated], names: Sequence[str], scratch: str | None = None) -> list[Annotated]:
    """Each part with ``src_path`` (categorical: all names in order) and the order columns (_file_idx, _row_idx)."""
    out = []
    for i, (a, n) in enumerate(zip(parts, names, strict=True)):
        if a.order != ["row_id"]:
            if scratch is None:
                raise ValueError(f"{n}: its rows must be numbered first")
            a = numbered(a, f"{scratch}/{i}")
        d = a.rows.withColumnRenamed("row_id", "_row_idx").withColumns({"_file_idx": F.lit(i), "src_path": F.lit(n)})
        out.append(Annotated(with_categories(d, "src_path", list(names)), a.var, ["_file_idx", "_row_idx"]))
    return out

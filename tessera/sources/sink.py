"""Sinks: sharded Parquet, sorted by position within each dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sizes import bytes_per_row, check_at_least_one, dense_layout, rows_of

#: Rows of a task, about, where shards are smaller or datasets cut them.
TASK_ROWS = 131_072

#: Codec names users may pass.
CODECS = ("zstd", "lz4", "snappy", "gzip", "none")


def write_sharded(rows: DataFrame, path: str, *, n_obs_per_chunk: int = 64, shard_size: int | str = "1GB", compression: str = "zstd", position: str = "pos", dataset: str | None = None, n_rows: int | None = None, mode: str = "errorifexists") -> int:
    """Writes rows in the order of position, at most a shard's rows a file; returns the rows of a shard.

    A shard is a multiple of a chunk. Files of a dataset (a partition directory) hold ranges of positions, so a reader of a
    row range skips files and row groups by their minima and maxima. One shuffle by (dataset, position); no task holds a dataset.
    """
    check_at_least_one(n_obs_per_chunk=n_obs_per_chunk)
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}")
    n_rows = rows.count() if n_rows is None else n_rows
    per_row = bytes_per_row(rows) if isinstance(shard_size, str) else 1.0
    _, shard = dense_layout(n_rows, n_obs_per_chunk, rows_of(shard_size, per_row))
    by = [dataset, position] if dataset else [position]
    # a task holds a whole shard's rows, so a file does too: the shard's number is a function of the position. Shards are counted a
    # dataset, so of many small datasets each has its own, far below a shard's rows: tasks go by rows too
    cut = rows.withColumn("_shard", F.floor(F.col(position) / shard))
    dealt = cut.repartitionByRange(max(1, min(20_000, max(-(-n_rows // shard), -(-n_rows // TASK_ROWS)))), *([dataset, "_shard"] if dataset else ["_shard"])).sortWithinPartitions(*by).drop("_shard")
    out = dealt.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", shard)
    (out.partitionBy(dataset) if dataset else out).parquet(path)
    return shard

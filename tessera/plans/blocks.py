"""The preshuffle plan: blocks of consecutive rows, shuffled, dealt to datasets; then rows shuffled within each dataset."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.keys import hash_key, ranked

BROADCAST_BLOCKS = 1_000_000


@dataclass(frozen=True)
class BlockPlan:
    """n_rows rows in blocks of block rows. Either rows a dataset (create) or a number of datasets (append) is given."""

    n_rows: int
    block: int
    shuffle: bool = True
    seed: int | str = 0
    rows_per_dataset: int | None = None
    n_datasets: int | None = None

    @property
    def n_blocks(self) -> int:
        return -(-self.n_rows // self.block)

    @property
    def blocks_per_dataset(self) -> int:
        """Whole blocks of a dataset; where that is one or less, everything goes into one dataset."""
        k = self.rows_per_dataset // self.block
        return k if k > 1 else max(1, self.n_blocks)

    @property
    def datasets(self) -> int:
        return self.n_datasets if self.n_datasets is not None else -(-self.n_blocks // self.blocks_per_dataset)

    def check(self) -> None:
        if self.n_datasets is not None and self.n_blocks < self.n_datasets:
            raise ValueError(f"{self.n_blocks} blocks of {self.block} rows can't be spread over {self.n_datasets} datasets: use a smaller shuffle_chunk_size")
        if self.rows_per_dataset is not None and self.rows_per_dataset // self.block <= 1 and self.n_blocks > 1:
            warnings.warn(f"dataset_size holds {self.rows_per_dataset // self.block} block(s): all rows go into one dataset", stacklevel=3)

    def blocks(self, spark: SparkSession) -> DataFrame:
        """block_id, block_pos, dataset_id."""
        ids = spark.range(self.n_blocks).withColumnRenamed("id", "block_id")
        if self.shuffle:
            placed = ranked(ids.withColumn("_key", hash_key(self.seed, "block", "block_id")), "_key", self.n_blocks, "block_pos", ["block_id"]).drop("_key")
        else:
            placed = ids.withColumn("block_pos", F.col("block_id"))
        return placed.withColumn("dataset_id", self._dataset(F.col("block_pos")))

    def _dataset(self, pos: Column) -> Column:
        if self.n_datasets is None:
            return F.floor(pos / self.blocks_per_dataset).cast("int")
        size, more = divmod(self.n_blocks, self.n_datasets)  # even tiles, the first ones one longer
        edge = more * (size + 1)
        return F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(F.floor((pos - edge) / max(size, 1)) + more).cast("int")

    def deal(self, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
        """rows with block_pos and dataset_id: arithmetic and a join with the plan, broadcast where its size allows."""
        own = rows.withColumn("block_id", F.floor(F.col(row_id) / self.block).cast("long"))
        if not self.shuffle:
            return own.withColumn("block_pos", F.col("block_id")).withColumn("dataset_id", self._dataset(F.col("block_pos"))).drop("block_id")
        plan = self.blocks(rows.sparkSession)
        return own.join(F.broadcast(plan) if self.n_blocks <= BROADCAST_BLOCKS else plan, "block_id").drop("block_id")


def place(rows: DataFrame, *, seed: int | str, shuffle: bool, sort: list[Column], ids: list[str], n_rows: int, n_datasets: int = 1) -> DataFrame:
    """rows with ``pos``: the place within the dataset, by sort keys, then shuffled or in the order (block_pos, ids).

    Without sort keys a large dataset is ranked in ranges of its random keys, so no task sorts a whole dataset.
    """
    if shuffle and not sort:
        return ranked(rows.withColumn("_key", hash_key(seed, "place", "dataset_id", *ids)), "_key", n_rows, "pos", ids, within=["dataset_id"], n_groups=n_datasets).drop("_key")
    last = [hash_key(seed, "place", "dataset_id", *ids), *ids] if shuffle else ["block_pos", *ids]
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy("dataset_id").orderBy(*sort, *last)) - 1).cast("long"))

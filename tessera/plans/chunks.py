"""Chunk and batch plans: which rows are read together, and which batch each row goes to.

The virtual row range [start, stop) of n rows is cut into chunks of ``chunk_size``. Shuffled, chunk ids stand in the order of
their md5 keys; the last in that order is the short one, wherever it lies in row space, so the chunks after it shift left. A
row's chunk is then arithmetic, with one scalar (the short chunk's id) taken from the plan, and only its place in the order
needs a join with the plan, an equi-join, never a range join. Requests are ``preload_nchunks`` chunks; within a request
rows are ranked and tiled into batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.keys import below, hash_key, key_of, ranked

#: A plan of up to so many chunks is broadcast; 24 bytes each.
BROADCAST_CHUNKS = 1_000_000


@dataclass(frozen=True)
class ChunkPlan:
    start: int
    stop: int
    chunk_size: int
    preload_nchunks: int
    batch_size: int
    shuffle: bool = False
    seed: int | str = 0
    drop_last: bool = False
    replacement: bool = False
    num_samples: int | None = None

    # ---- arithmetic

    @property
    def n(self) -> int:
        return self.stop - self.start

    @property
    def n_chunks(self) -> int:
        if self.replacement:
            return self._drawn // self.chunk_size + bool(self._tail)
        return -(-self.n // self.chunk_size)

    @property
    def _drawn(self) -> int:
        return self.n if self.num_samples is None else self.num_samples

    @property
    def _tail(self) -> int:
        return 0 if self.drop_last else self._drawn % self.chunk_size

    @property
    def odd(self) -> int:
        """Size of the last chunk in the order."""
        if self.replacement:
            return self._tail or self.chunk_size
        return self.n % self.chunk_size or self.chunk_size

    @property
    def n_rows(self) -> int:
        """Rows in all chunks, repeats counted."""
        return (self._drawn // self.chunk_size) * self.chunk_size + self._tail if self.replacement else self.n

    @property
    def n_requests(self) -> int:
        return -(-self.n_chunks // self.preload_nchunks)

    @property
    def request_rows(self) -> int:
        return self.chunk_size * self.preload_nchunks

    @property
    def n_batches(self) -> int:
        """Batches that the plan yields."""
        full = self.n_rows // self.batch_size if self.drop_last else -(-self.n_rows // self.batch_size)
        return full if self.num_samples is None else min(full, self._wanted)

    @property
    def _wanted(self) -> int:
        return self.num_samples // self.batch_size if self.drop_last else -(-self.num_samples // self.batch_size)

    @property
    def kept_in_last(self) -> int:
        """Rows of the last request that batches may use."""
        rows = self.n_rows - (self.n_requests - 1) * self.request_rows
        return rows // self.batch_size * self.batch_size if self.drop_last else rows

    # ---- as tables

    def chunks(self, spark: SparkSession) -> DataFrame:
        """chunk_id, pos (place in the order), request_id, start, stop."""
        ids = spark.range(self.n_chunks).withColumnRenamed("id", "chunk_id")
        lit = F.lit
        if self.replacement:
            size = F.when(F.col("chunk_id") == self.n_chunks - 1, lit(self.odd)).otherwise(lit(self.chunk_size)).cast("long")
            first = lit(self.start) + below(hash_key(self.seed, "start", "chunk_id"), self.n - F.least(lit(self.chunk_size), lit(self.n)) + 1)
            out = ids.select("chunk_id", F.col("chunk_id").alias("pos"), first.cast("long").alias("start"), size.alias("_size"))
            out = out.withColumn("stop", F.least(F.col("start") + F.col("_size"), lit(self.stop)).cast("long")).drop("_size")
        else:
            if self.shuffle:
                placed = ranked(ids.withColumn("_key", hash_key(self.seed, "chunk", "chunk_id")), "_key", self.n_chunks, "pos", ["chunk_id"]).drop("_key")
            else:
                placed = ids.withColumn("pos", F.col("chunk_id"))
            pivot = self.pivot(spark)
            shift = F.when(F.col("chunk_id") > pivot, self.odd - self.chunk_size).otherwise(0)
            first = (self.start + F.col("chunk_id") * self.chunk_size + shift).cast("long")
            size = F.when(F.col("chunk_id") == pivot, self.odd).otherwise(self.chunk_size)
            out = placed.select("chunk_id", "pos", first.alias("start"), (first + size).cast("long").alias("stop"))
        return out.select("chunk_id", "pos", F.floor(F.col("pos") / self.preload_nchunks).cast("long").alias("request_id"), "start", "stop")

    def pivot(self, spark: SparkSession) -> int:
        """The id of the last chunk in the order: a maximum, one scalar."""
        if not self.shuffle:
            return self.n_chunks - 1
        if self.n_chunks <= 10_000:
            return max(range(self.n_chunks), key=lambda c: (key_of(self.seed, "chunk", c), c))
        best = spark.range(self.n_chunks).agg(F.max(F.struct(hash_key(self.seed, "chunk", "id").alias("k"), F.col("id"))).alias("m"))
        return best.select("m.id").first()[0]

    def _chunk_of(self, at: Column, pivot: int) -> Column:
        p = at - self.start
        cs, edge = self.chunk_size, pivot * self.chunk_size
        div = lambda x: F.floor(x / cs).cast("long")
        return F.when(p < edge, div(p)).when(p < edge + self.odd, F.lit(pivot).cast("long")).otherwise(div(p - self.odd) + 1)

    def rows(self, df: DataFrame, *, obs_id: str = "obs_id", dataset: str | None = None, cut: bool = True) -> DataFrame:
        """df's rows that the plan reads, with chunk_id, chunk_pos, request_id, batch_id and pos_in_batch.

        batch_id counts within the request; repeats of a row under replacement are rows of their own. The filter on obs_id
        reaches the Parquet scan; the one shuffle is by request.
        """
        spark = df.sparkSession
        inside = df.filter((F.col(obs_id) >= self.start) & (F.col(obs_id) < self.stop))
        hint = F.broadcast if self.n_chunks <= BROADCAST_CHUNKS else (lambda x: x)
        if self.replacement:
            drawn = self.chunks(spark).select("chunk_id", F.col("pos").alias("chunk_pos"), "request_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("_at"))
            out = inside.join(drawn, inside[obs_id] == drawn["_at"]).drop("_at")
        elif self.shuffle:
            own = inside.withColumn("chunk_id", self._chunk_of(F.col(obs_id), self.pivot(spark)))
            out = own.join(hint(self.chunks(spark).select("chunk_id", F.col("pos").alias("chunk_pos"), "request_id")), "chunk_id")
        else:
            chunk = F.floor((F.col(obs_id) - self.start) / self.chunk_size).cast("long")
            out = inside.withColumn("chunk_id", chunk).withColumn("chunk_pos", F.col("chunk_id"))
            out = out.withColumn("request_id", F.floor(F.col("chunk_pos") / self.preload_nchunks).cast("long"))
        return self.batches(out, obs_id=obs_id, dataset=dataset) if cut else out

    def batches(self, out: DataFrame, *, obs_id: str = "obs_id", dataset: str | None = None) -> DataFrame:
        of = W.partitionBy("request_id")
        memory = [*([dataset] if dataset else []), "chunk_pos", obs_id]
        if self.shuffle and self.drop_last and self.kept_in_last < self.n_rows - (self.n_requests - 1) * self.request_rows:
            # the tail of the in-memory block goes, not random rows
            out = out.withColumn("_mem", F.row_number().over(of.orderBy(*memory)))
            out = out.filter((F.col("request_id") < self.n_requests - 1) | (F.col("_mem") <= self.kept_in_last)).drop("_mem")
        if self.shuffle:
            out = out.withColumn("_key", hash_key(self.seed, "row", "chunk_pos", obs_id))
            rank = F.row_number().over(of.orderBy("_key", "chunk_pos", obs_id)) - 1
        else:
            rank = F.row_number().over(of.orderBy(*memory)) - 1
        out = out.withColumn("_rank", rank)
        if self.drop_last and not self.shuffle:
            out = out.filter((F.col("request_id") < self.n_requests - 1) | (F.col("_rank") < self.kept_in_last))
        out = out.withColumn("batch_id", F.floor(F.col("_rank") / self.batch_size).cast("long")).withColumn("pos_in_batch", (F.col("_rank") % self.batch_size).cast("long"))
        if self.num_samples is not None:
            ordinal = F.col("request_id") * (self.request_rows // self.batch_size) + F.col("batch_id")
            out = out.filter(ordinal < self._wanted)
        return out.drop("_rank", "_key")

    # ---- on the driver, for one request after the other

    def order(self) -> np.ndarray:
        """Chunk ids in their order."""
        if not self.shuffle or self.replacement:
            return np.arange(self.n_chunks)
        return np.array(sorted(range(self.n_chunks), key=lambda c: (key_of(self.seed, "chunk", c), c)), np.int64)

    def slices(self) -> list[slice]:
        """All chunks in their order."""
        out = []
        if self.replacement:
            for c in range(self.n_chunks):
                a = self.start + int(key_of(self.seed, "start", c)[:8], 16) % (self.n - min(self.chunk_size, self.n) + 1)
                out.append(slice(a, min(a + (self.odd if c == self.n_chunks - 1 else self.chunk_size), self.stop)))
            return out
        order = self.order()
        pivot = int(order[-1]) if len(order) else 0
        for c in order.tolist():
            a = self.start + c * self.chunk_size + (self.odd - self.chunk_size if c > pivot else 0)
            out.append(slice(a, a + (self.odd if c == pivot else self.chunk_size)))
        return out


def worker_of(pos: Column | str, n_chunks: int, n_workers: int) -> Column:
    """The worker that takes the chunk at a place in the order: even tiles, the first n_chunks % n_workers one longer."""
    p = F.col(pos) if isinstance(pos, str) else pos
    size, more = divmod(n_chunks, n_workers)
    edge = more * (size + 1)
    late = F.floor((p - edge) / size) + more if size else F.lit(more)
    return F.when(p < edge, F.floor(p / (size + 1))).otherwise(late).cast("long")

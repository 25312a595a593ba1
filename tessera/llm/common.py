"""Helpers shared by the training-data operators: shared-folder tables, size-checked joins, word and rolling hashes.

Words are maximal runs without the ASCII white space ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` without an argument uses
the same six characters, so it is the scalar form of every vectorised word splitter here.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scan import scratch_dir

#: A table up to so many bytes may be broadcast; its size is read from its files first. In memory it takes about 13 times that.
BROADCAST_BYTES = 8 << 20
#: Parts that a heavy key's rows are dealt to where its group is too long to be broadcast.
SALTS = 64
#: Bytes of text that one vectorised step holds; longer single documents are a step of their own.
STEP_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_scratch: dict[str, SparkSession] = {}


# ---------------------------------------------------------------- tables in the shared folder

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _forget(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended: nothing is left to do
        pass
    _scratch.pop(path, None)


@atexit.register
def _forget_all() -> None:
    for path, spark in list(_scratch.items()):
        _forget(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends."""
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def local_path(path: str) -> str:
    """The path as the operating system opens it. The shared folder must be mounted where files are memory-mapped."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return path


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors. With its bytes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), size_of(spark, path)


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    """df with a broadcast hint if its files are below BROADCAST_BYTES; else unhinted, and a shuffle join follows."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def heavy_join(rows: DataFrame, groups: DataFrame, keys: list[str], n_rows: int, size: str) -> DataFrame:
    """Left join of rows with one row for each key, safe where one key holds a large share of the rows.

    At most 1000 keys can hold a thousandth of the rows each: those are broadcast if their table's bytes allow it (keys may be
    long), else they are repeated under SALTS numbers and the rows dealt over these. The rest are joined by a shuffle in which no
    key has over a thousandth of the rows. keys: not null on both sides.
    """
    cut = max(1, n_rows // 1000)
    put = [c for c in groups.columns if c not in keys]
    heavy, n_bytes = materialize(groups.filter(F.col(size) > cut).withColumn("_heavy", F.lit(True)), "heavy-groups")
    rest = groups.filter(F.col(size) <= cut)
    if n_bytes <= BROADCAST_BYTES:
        first = rows.join(F.broadcast(heavy), keys, "left")
    else:
        salted = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        first = rows.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns if c not in keys)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")
    done = first.filter(F.col("_heavy")).drop("_heavy")
    todo = first.filter(F.col("_heavy").isNull()).drop("_heavy", *put)
    return done.unionByName(todo.join(rest, keys, "left"))


def keyed_join(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, size: str) -> DataFrame:
    """Inner join of rows with one row for each key (a number), safe where one key holds a large share of the rows.

    At most 1000 keys can hold a thousandth of the rows each. Those, bounded whatever the data, are broadcast, and the
    shuffle gets the rows of the others only.
    """
    cut = max(1, n_rows // 1000)
    heavy = groups.filter(F.col(size) > cut)
    keys = [r[0] for r in heavy.select(key).collect()]
    rest = groups.filter(F.col(size) <= cut)
    if not keys:
        return rows.join(rest, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.filter(~F.col(key).isin(keys)).join(rest, key))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def wide(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt to many tasks: few rows that each take long to work on. The number is given, so it isn't lowered again."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)


# ---------------------------------------------------------------- what workers hold

_caches: dict[str, Callable[[], None]] = {}


def holding(name: str, clear: Callable[[], None]) -> None:
    """Says that this worker keeps something between tasks of one kind."""
    _caches[name] = clear


def enter(name: str | None = None) -> None:
    """A task begins: what tasks of another kind have left in this worker goes, and freed memory returns to the system."""
    for other in [x for x in _caches if x != name]:
        _caches.pop(other)()
    if name is not None:
        _powers.clear()
    leave()


def leave() -> None:
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- Arrow batches

def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    n = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    at, cum = 0, np.cumsum(n)
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the int64 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def over(df: DataFrame, columns: list[str], schema: str, f: Callable[[pa.RecordBatch], Iterator[dict] | dict], limit: int = STEP_BYTES, name: str | None = None) -> DataFrame:
    """mapInArrow over slices of bounded text; f returns the columns of one output batch, or yields several such."""

    def run(batches):
        enter(name)
        for batch in batches:
            for part in steps(batch, limit=limit):
                got = f(part)
                for out in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_pydict(out)
        leave()

    return df.select(*columns).mapInArrow(run, schema)


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n as 64-bit words, kept up to a few MB."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        got = np.empty(max(n + 1, STEP_BYTES + 4096), np.uint64)
        got[0] = 1
        done = 1
        while done < len(got):
            k = min(done, len(got) - done)
            got[done : done + k] = got[:k] * np.uint64(pow(base, done, 1 << 64))
            done += k
        if len(got) <= 8 * STEP_BYTES:
            _powers[base] = got
    return got


class Rolling:
    """Polynomial prefix sums modulo 2**64 over a sequence of numbers: the hash of any slice is one difference."""

    def __init__(self, values: np.ndarray, base: int = 0x5851F42D4C957F2D):
        n = len(values)
        self.inv = powers(_inverse(base), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n)[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of values[start:end]; equal slices agree wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64) * _ODD)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and how many each row has before it (len(offsets) entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # rows end words too
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the least of h[i : i + width]; doubling, so log2(width) passes. Nothing if h is shorter than width."""
    if len(h) < width:
        return h[:0]
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as sorted disjoint ranges; touching ones are joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:] - 1, len(start) - 1)]


# ---------------------------------------------------------------- packed exchange

#: Hash ranges and shuffle partitions of a packed exchange at most: beyond 2 TB of text ranges grow, not the number of pieces.
MAX_RANGES, MAX_PARTITIONS = 1 << 17, 1 << 14


def buckets_for(docs: DataFrame, text: str = "text", each: int = 16 << 20) -> int:
    """A power of two of hash ranges: about one for each 16 MB of text, 16 at least, MAX_RANGES at most."""
    n = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MAX_RANGES, 1 << max(4, (n // each).bit_length()))


def split_by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted 64-bit keys that share their leading bits; n_buckets: a power of two."""
    b = (keys >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64) if n_buckets > 1 else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
        if hi > lo:
            yield int(b[lo]), slice(lo, hi)


BLOBS = "kind int, bucket int, data binary"
_EMPTY = -1
FOLD_BYTES = 16 << 20


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def reduce_blobs(df: DataFrame, n_buckets: int, schema: str, f: Callable[[int, dict[int, list[bytes]]], Iterator[pa.RecordBatch]], fold: Callable[[dict[int, list[bytes]]], dict[int, list[bytes]]] | None = None) -> DataFrame:
    """Brings the blobs of a bucket together and calls f(bucket, {kind: blobs}) once for each bucket, also for those without blobs:
    so each range's files are written, and a reader that misses one fails instead of finding nothing.

    A bucket is a range of hash values and mappers combine equal keys, so no bucket depends on how often one key occurs. A
    partition holds many buckets where there are more than MAX_PARTITIONS; its task works on one after the other. With fold,
    which adds up blobs of a bucket, never more than FOLD_BYTES of new ones are held beside the sums.
    """
    every = df.sparkSession.range(n_buckets).select(F.lit(_EMPTY).cast("int").alias("kind"), F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))

    def run(batches):
        enter()
        at, held, size = None, {}, 0
        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    if at is not None:
                        yield from f(at, held)
                    at, held, size = bucket, {}, 0
                if kind != _EMPTY:
                    held.setdefault(kind, []).append(data)
                    size += len(data)
                if fold and size > FOLD_BYTES:
                    held, size = fold(held), 0
        if at is not None:
            yield from f(at, held)
        held = {}
        leave()

    return df.unionByName(every).repartition(min(n_buckets, MAX_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first, dtype=v.dtype) for v in values)

"""Which 64-bit hashes occur more than once in a corpus: counted by hash range, kept as sorted arrays that workers memory-map.

A range is the hash's leading bits, and within it a key is the next 32: a filter, with wrong hits but no misses. Mappers send each key
once with its count, so a key that fills a third of the corpus costs a range no more than any other.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import BLOBS, STEP_BYTES, blobs, local_path, materialize, new_path, reduce_blobs, split_by_bucket, steps

#: Hashes a mapper holds before it sends them.
FLUSH = 3_000_000


def save_array(file: str, a: np.ndarray) -> None:
    """Whole or not at all, under one name however often the task runs."""
    own = f"{file}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, a)
    os.replace(own, file)


@functools.lru_cache(maxsize=2048)
def open_array(file: str) -> np.ndarray:
    """Every range writes its files, empty ones too: one that is missing is an error (a folder that is not mounted), not an empty range."""
    return np.load(file, mmap_mode="r") if os.path.getsize(file) > 128 else np.load(file)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths in one compressed piece."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3).tolist()
    at, out = 8 + 24 * n, []
    for kind, size, count in head:
        out.append(np.frombuffer(raw, f"{chr(kind)}{size}", count, at))
        at += size * count
    return out


def short_keys(h: np.ndarray, n: int) -> np.ndarray:
    """The 32 bits after the range's."""
    return (h >> np.uint64(32 - (n.bit_length() - 1))).astype(np.uint32)


@dataclass(frozen=True)
class KeyFiles:
    path: str
    n: int

    def find(self, h: np.ndarray, name: str = "key") -> np.ndarray:
        """For each hash whether it is there."""
        order = np.argsort(h)
        sorted_h = h[order]
        out = np.zeros(len(h), bool)
        for b, s in split_by_bucket(sorted_h, self.n):
            own = open_array(f"{self.path}/{name}-{b}.npy")
            if not len(own):
                continue
            want = short_keys(sorted_h[s], self.n)
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            out[order[s]] = own[at] == want
        return out


def repeated(docs: DataFrame, columns: list[str], hashes: Callable[[pa.RecordBatch], np.ndarray], n: int, name: str, limit: int = STEP_BYTES, hot: int | None = None) -> KeyFiles:
    """The hashes found twice or more; with hot, those found more often than that are also kept under the name ``hot``."""
    path = local_path(new_path(docs.sparkSession, name))

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c = np.diff(np.append(first, len(h)))
        h, many, out = h[first], c > 1, []
        for b, s in split_by_bucket(h, n):
            m = np.flatnonzero(many[s]).astype(np.uint32)
            out.append((0, b, pack(np.diff(short_keys(h[s], n), prepend=np.uint32(0)), m, c[s][m].astype(np.uint32))))
        return blobs(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, limit=limit):
                got = hashes(part)
                if len(got):
                    held.append(got)
                    size += len(got)
                if size > max(FLUSH, 64 * n):  # pieces of many keys also where there are many ranges
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for x in held.get(0, []):
            step, m, c = unpack(x)
            keys.append(np.cumsum(step, dtype=step.dtype))
            own = np.ones(len(step), np.uint32)
            own[m] = c
            counts.append(own)
        key, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, c = key[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        c = np.add.reduceat(c, first, dtype=np.int64) if len(first) else c
        key = key[first]
        save_array(f"{path}/key-{bucket}.npy", key[c > 1])
        if hot is not None:
            save_array(f"{path}/hot-{bucket}.npy", key[c > hot])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([int((c > 1).sum())], pa.int64())})

    materialize(reduce_blobs(docs.select(*columns).mapInArrow(count, BLOBS), n, "bucket int, n long", store), name)
    return KeyFiles(path, n)

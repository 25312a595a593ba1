"""Substring deduplication of word windows by level-wise doubling.

A window of 20 words can only repeat if the windows of 10 words it consists of do, and those only if theirs of 5 do. So
windows repeated at 5 words are found first; where two of them stand side by side, the window of twice the length is a candidate of the next
level, until 20. The first levels are filters (32 bits of hash within a hash range: wrong hits vanish at the next level), the last
compares 64 further bits and keeps for each repeated window its earliest (doc_id, start). Each document then looks its candidates up
in memory-mapped sorted arrays; texts never move.

A word goes if a window over it also starts earlier: in a smaller doc_id, or in the same at an earlier word. Edge cases: null and empty
texts have no words; a null doc_id counts as larger than any other; rows of one doc_id count as one document, so of two equal
rows neither is earlier and both stay; texts of fewer than 20 words stay whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, Rolling, blobs, buckets_for, local_path, materialize, new_path, over, reduce_blobs, split_by_bucket, steps, text_bytes, words
from tessera.llm.keyfiles import FLUSH, KeyFiles, open_array, pack, repeated, save_array, unpack

#: Words of the first level; doubled until the window's length.
FIRST, WINDOW = 5, 20
_NULL = np.iinfo(np.int64).max
_STEP = 2 << 20


class Text:
    """The words of a slice of documents and hashes of their windows."""

    def __init__(self, part: pa.RecordBatch, window: int = WINDOW):
        self.data, offs = text_bytes(part.column(part.schema.get_field_index("text")))
        self.start, self.end, self.before = words(self.data, offs)
        self.row = np.repeat(np.arange(part.num_rows), np.diff(self.before))
        self.word = Rolling(self.data).slices(self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.sums = Rolling(self.word)
        self.last = np.repeat(self.before[1:], np.diff(self.before))  # end of its document, for each word

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.sums.slices(at, at + n)

    def every(self, n: int) -> np.ndarray:
        """Where windows of n words start."""
        i = np.arange(len(self.word))
        return i[i + n <= self.last]

    def candidates(self, n: int, level: KeyFiles | None, first: int) -> np.ndarray:
        """Starts of windows of n words whose halves are both repeated."""
        if n <= first:
            return self.every(n)
        half = n // 2
        at = self.every(half)
        hit = np.zeros(len(self.word) + half + 1, bool)
        hit[at[level.find(self.windows(at, half))]] = True
        at = self.every(n)
        return at[hit[at] & hit[at + half]]


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.fill_null(part.column(part.schema.get_field_index("doc_id")), int(_NULL))).astype(np.int64)


def earliest(docs: DataFrame, level: KeyFiles, n: int, window: int, first: int) -> str:
    """For each repeated window its earliest (doc_id, start), as sorted arrays by range; returns their path."""
    path = local_path(new_path(docs.sparkSession, "windows"))

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, key, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = h >> np.uint64(65 - n.bit_length())
        order = np.lexsort((start, doc, key, bucket))
        h, key, doc, start = h[order], key[order], doc[order], start[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[order][1:] != bucket[order][:-1])])
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(key))) > 1
        names, doc = np.unique(doc[at], return_inverse=True)
        key, start = key[at], start[at].astype(np.uint32)
        out = []
        for b, s in split_by_bucket(h[at], n):
            own, index = np.unique(doc[s], return_inverse=True)
            out.append((0, b, pack(np.diff(key[s], prepend=np.uint64(0)), names[own], index.astype(np.uint32), start[s], np.packbits(many[s]))))
        return blobs(out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, limit=_STEP):
                t = Text(part)
                at = t.candidates(window, level, first)
                if len(at):
                    row = t.row[at]
                    held.append((t.windows(at, window), second(t, at, window), _ids(part)[row], at - t.before[row]))
                    size += len(at)
                if size > FLUSH // 4:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.uint32, bool)]
        for x in held.get(0, []):
            step, names, index, start, many = unpack(x)
            for c, v in zip(cols, (np.cumsum(step, dtype=np.uint64), names[index], start, np.unpackbits(many, count=len(step)).astype(bool)), strict=True):
                c.append(v)
        key, doc, start, many = map(np.concatenate, cols)
        order = np.lexsort((start, doc, key))
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        n_of = np.diff(np.append(at, len(key)))
        twice = (n_of > 1) | (np.logical_or.reduceat(many[order], at) if len(at) else many)
        at = at[twice]
        save_array(f"{path}/key-{bucket}.npy", key[at])
        save_array(f"{path}/doc-{bucket}.npy", doc[order][at])
        save_array(f"{path}/start-{bucket}.npy", start[order][at])
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(at)], pa.int64())})

    materialize(reduce_blobs(docs.select("doc_id", "text").mapInArrow(emit, BLOBS), n, "n long", store), "windows")
    return path


def second(t: Text, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the windows that is independent of the one that gives their range."""
    return Rolling(t.word, base=0x2545F4914F6CDD1D).slices(at, at + window)


def removed(t: Text, ids: np.ndarray, at: np.ndarray, path: str, n: int, window: int) -> np.ndarray:
    """For each word whether it goes."""
    h, key = t.windows(at, window), second(t, at, window)
    order = np.lexsort((key, h >> np.uint64(65 - n.bit_length())))
    row = t.row[at]
    doc, start = ids[row], at - t.before[row]
    later = np.zeros(len(at), bool)
    for b, s in split_by_bucket(h[order], n):
        own = open_array(f"{path}/key-{b}.npy")
        if not len(own):
            continue
        q = order[s]
        i = np.minimum(np.searchsorted(own, key[q]), len(own) - 1)
        hit = own[i] == key[q]
        q, i = q[hit], i[hit]
        d, w = open_array(f"{path}/doc-{b}.npy")[i], open_array(f"{path}/start-{b}.npy")[i].astype(np.int64)
        later[q] = (d < doc[q]) | ((d == doc[q]) & (w < start[q]))
    edge = np.zeros(len(t.word) + 1, np.int64)
    np.add.at(edge, at[later], 1)
    np.add.at(edge, at[later] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with texts the kept words (kept_text)."""
    if window % first or (window // first) & (window // first - 1):
        raise ValueError("window must be first times a power of two")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = buckets_for(docs)
    level, size = None, first
    while size < window:
        def hashes(part: pa.RecordBatch, size=size, level=level):
            t = Text(part)
            return t.windows(t.candidates(size, level, first), size)

        level = repeated(docs, ["text"], hashes, n, f"windows-{size}", _STEP)
        size *= 2
    path = earliest(docs, level, n, window, first)

    def run(part: pa.RecordBatch) -> dict:
        t = Text(part)
        at = t.candidates(window, level, first)
        gone = removed(t, _ids(part), at, path, n, window)
        kept, digests = [], []
        raw, total = t.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
        before, start, end = t.before.tolist(), t.start, t.end
        n_gone = total[t.before[1:]] - total[t.before[:-1]]
        for r in range(part.num_rows):
            a, b = before[r], before[r + 1]
            if n_gone[r]:
                i = a + np.flatnonzero(~gone[a:b])
                text = b" ".join([raw[x:y] for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)])
            else:
                text = b" ".join(raw[start[a] : end[b - 1]].split()) if b > a else b""
            digests.append(hashlib.sha256(text).hexdigest())
            if texts:
                kept.append(text.decode())
        out = {"doc_id": part.column(0), "n_words": pa.array(np.diff(t.before), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return out | ({"kept_text": pa.array(kept, pa.string())} if texts else {})

    return over(docs, ["doc_id", "text"], "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts, run, _STEP)


def op10(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Interpolated modified Kneser-Ney trigrams of words, counted in Spark, stored as sorted hash arrays that workers memory-map.

Words are counted first, by ranges of a 64-bit hash; a word's number is its rank by count within its range, times the ranges, plus
the range, so frequent words have small numbers. Trigrams u v w then go, sorted and packed, to the range of their
middle word v: there the counts of uvw, those of the context uv and the numbers of different words before vw are all complete. A middle
word of over HOT occurrences is dealt by (v, u) in place of v, so no range depends on one word; there only the numbers of words
before vw are partial, and one more exchange, of hot pairs alone, adds them up. A last one sums what each word has as a context
(v) and before it (w).

A table of a range holds 48 bits of hash a key: the first ones by an index of where their block starts, the rest in a sorted
array, apart for keys seen once, which need no values. Every range writes all its files, so a missing one is an error. Files of
a range have one name and one content however often its task runs.

A scorer takes STEP_TOKENS tokens at once and goes through the ranges once for these: it opens the files of one range, looks up
all tokens that fall there, and lets go of them. So it holds the tables of one range, however many there are, and the work for each
range (ranges grow with the corpus) is spread over many tokens.

Probability: p(w|uv) = (c(uvw) - D(c(uvw))) / c(uv.) + (D1 N1(uv.) + D2 N2(uv.) + D3 N3+(uv.)) / c(uv.) * p(w|v); p(w|v) and p(w)
likewise with the numbers of different words before vw and w in place of counts (after the begin symbol: with counts), p(w) interpolated with
1 / (V + 1). Discounts come from the counts of counts of each order; where those are too few to define one, 0.5, 1 and 1.5 hold. A
context that training has not seen is left out. Two begin symbols precede a text; its last token is the end symbol.

Edge cases: null and empty texts are one end token; an empty training set gives N = V = 0, base (0+1)/(0+1) and the uniform
model; repeated rows count as often as they occur; a null doc_id has no number and hashes as the text ``null``.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, Rolling, blobs, buckets_for, enter, leave, local_path, lowered, materialize, mix, new_path, reduce_blobs, split_by_bucket, steps, summed, text_bytes, words
from tessera.llm.keyfiles import pack, save_array, unpack

_END = np.uint64(0x7A6B5C4D3E2F1A0B)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Numbers of the begin symbol and of words that training has not seen.
_BEGIN, _NONE = (1 << 39) - 1, (1 << 39) - 2
_STEP = 2 << 20
#: Occurrences from which a middle word's trigrams are dealt by the word before it, too.
HOT = 1 << 18
#: Words or trigrams that a mapper adds up before it sends them.
FLUSH = 1_500_000
#: Tokens that a scorer takes through the ranges at once; a worker then holds about 80 bytes for each.
STEP_TOKENS = 3_000_000


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of the rows, end symbols included, and the offsets of the rows."""
    data, offs = text_bytes(part.column(part.schema.get_field_index("text")))
    start, end, before = words(data, offs)
    out = np.empty(len(start) + len(offs) - 1, np.uint64)
    rows = before + np.arange(len(offs))
    ends = rows[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends] = _END
    out[inner] = Rolling(lowered(data)).slices(start, end)
    return out, rows


def gathered(batches: Iterator[pa.RecordBatch], limit: int, *columns: str) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], np.ndarray]]:
    """Slices of over limit tokens together: their columns, the hashes of their tokens, and the offsets of all their rows."""
    held, size = [], 0
    for batch in batches:
        for part in steps(batch, limit=_STEP):
            h, rows = tokens(part)
            held.append((part.select(columns), h, rows[1:] + size))
            size += len(h)
            if size > limit:
                parts, hashes, rows = zip(*held, strict=True)
                yield parts, hashes, np.concatenate([[0], *rows])
                held, size = [], 0
    if size:
        parts, hashes, rows = zip(*held, strict=True)
        yield parts, hashes, np.concatenate([[0], *rows])


def _save(path: str, **arrays: np.ndarray) -> None:
    for name, a in arrays.items():
        own = f"{path}-{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, a)
        os.replace(own, f"{path}-{name}.npy")


def save_arrays(file: str, *arrays: np.ndarray) -> None:
    """Arrays with their types and lengths in one file, each at a multiple of eight bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    save_array(file, np.frombuffer(b"".join([head.tobytes(), *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)]), np.uint8))


def open_arrays(file: str) -> list[np.ndarray]:
    """The arrays of a file, mapped until the last of them is let go."""
    with open(file, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    at = 10 + int.from_bytes(data[8:10], "little")  # behind the header of the .npy format
    n = int(np.frombuffer(data, np.int64, 1, at)[0])
    head = np.frombuffer(data, np.int64, 3 * n, at + 8).reshape(n, 3).tolist()
    at, out = at + 8 + 24 * n, []
    for kind, size, count in head:
        out.append(np.frombuffer(data, f"{chr(kind)}{size}", count, at))
        at += size * count + -size * count % 8
    return out


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D1, D2, D3+ from the numbers of types seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(np.clip(d, 0.01, k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


@dataclass(frozen=True)
class Words:
    """The vocabulary: for each range sorted hashes (key), counts (c) and ranks by count (rank)."""

    path: str
    n: int
    hot: int
    train_tokens: int
    vocabulary: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted hashes."""
        number, count = np.full(len(h), _NONE, np.int64), np.zeros(len(h), np.int64)
        for b, s in split_by_bucket(h, self.n):
            keys, c, rank = open_arrays(f"{self.path}/word-{b}.npy")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[s]), len(keys) - 1)
            hit = keys[at] == h[s]
            number[s][hit] = rank[at[hit]].astype(np.int64) * self.n + b
            count[s][hit] = c[at[hit]]
        return number, count


def count_words(docs: DataFrame, n: int, path: str, hot: int, flush: int) -> Words:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        held, size = [], 0

        def send() -> pa.RecordBatch:
            key, c = summed(*map(np.concatenate, zip(*held, strict=True)))
            return blobs([(0, b, pack(np.diff(key[s], prepend=np.uint64(0)), _least(c[s]))) for b, s in split_by_bucket(key, n)])

        for batch in batches:
            for part in steps(batch, limit=_STEP):
                held.append(np.unique(tokens(part)[0], return_counts=True))
                size += len(held[-1][0])
                if size > flush:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        key, c = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for x in held.get(0, []):
            step, own = unpack(x)
            key, c = np.concatenate([key, np.cumsum(step, dtype=np.uint64)]), np.concatenate([c, own.astype(np.uint64)])
        key, c = summed(key, c)
        rank = np.empty(len(key), np.int64)
        rank[np.argsort(c, kind="stable")[::-1]] = np.arange(len(key))
        save_arrays(f"{path}/word-{bucket}.npy", key, _least(c), _least(rank))
        yield pa.RecordBatch.from_pydict({"tokens": [int(c.sum())], "types": [len(key)]})

    stats, _ = materialize(reduce_blobs(docs.select("text").mapInArrow(count, BLOBS), n, "tokens long, types long", store), "word-stats")
    total = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    return Words(path, n, hot, *total)


# ---------------------------------------------------------------- trigrams

def contexts(words: Words, hashes: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers and counts of the distinct tokens, the begin symbol last (as a hot word), and which of these u, v and w of each token are."""
    own = [np.unique(h, return_inverse=True) for h in hashes]
    found, back = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
    back = back.astype(np.int32)
    w = np.concatenate([i[x] for i, (_, x) in zip(np.split(back, np.cumsum([len(x) for x, _ in own])[:-1]), own, strict=True)])
    number, count = words.find(found)
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    first = rows[:-1]
    v[first] = u[first] = len(found)
    u[first[np.diff(rows) > 1] + 1] = len(found)
    return np.append(number, _BEGIN), np.append(count, words.hot + 1), u, v, w


def _u(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) if x.dtype == np.int64 else x.astype(np.uint64)


def hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(_u(a) * _C1 + mix(_u(b) * _C2 + _C3))


def hash3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(hash2(a, b) * _C3 + _u(c) * _C2)


def place(v: np.ndarray, x: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The range of a middle word, dealt by x too where it is hot."""
    out = mix(_u(v) + _C3)
    out[hot] = hash2(v[hot], x[hot])
    return leading(out, n)


def leading(h: np.ndarray, n: int) -> np.ndarray:
    """The range of a hash."""
    return (h >> np.uint64(65 - n.bit_length())).astype(np.int32 if n > 1 << 15 else np.int16)


def by_range(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range and the places of its rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cut):
        if len(own):
            yield int(bucket[own[0]]), own


def _least(x: np.ndarray) -> np.ndarray:
    """x in the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**39 as five planes of bytes: the high ones are mostly zeros."""
    return np.ascontiguousarray(x.astype(np.int64)).view(np.uint8).reshape(-1, 8)[:, :5].T.ravel()


def unplanes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = x.reshape(5, -1).T
    return out.view(np.int64).ravel()


def ordered(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of v, u, w: two sorts, since 39 bits each make two words."""
    return np.lexsort(((u & 0xFFFF) << 40 | w, v << 24 | u >> 16))


def added(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct trigrams in order, and their counts."""
    order = ordered(v, u, w)
    v, u, w = v[order], u[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(v)])
    return v[first], u[first], w[first], np.add.reduceat(c[order], first) if len(first) else c[order]


def packed_trigrams(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    dv = np.diff(v, prepend=0)
    du = np.where(dv == 0, np.diff(u, prepend=0), u)
    many = np.flatnonzero(c > 1)
    return pack(planes(dv), planes(du), planes(w), np.diff(many, prepend=0).astype(np.uint32), _least(c[many]))


def unpacked_trigrams(x: bytes) -> tuple[np.ndarray, ...]:
    dv, du, w, many, times = unpack(x)
    dv, du, w = map(unplanes, (dv, du, w))
    v = np.cumsum(dv)
    run = np.cumsum(du)
    first = np.flatnonzero(dv != 0)  # a run of one v starts with u itself
    if len(first):
        start = np.zeros(len(v), np.int64)
        start[first] = run[first] - du[first]
        run -= np.maximum.accumulate(start)
    c = np.ones(len(v), np.int64)
    c[np.cumsum(many, dtype=np.int64)] = times
    return v, run, w, c


def count_trigrams(words: Words, docs: DataFrame, flush: int) -> DataFrame:
    """Writes the tables tri, ctx and pair; returns blobs: statistics (0), what words have from their pairs (1), parts of hot pairs (2)."""
    n, path = words.n, words.path

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        for _, hashes, rows in gathered(batches, flush):
            number, times, u, v, w = contexts(words, hashes, rows)
            hot = (times > words.hot)[v]
            u, v, w = number[u], number[v], number[w]
            out = []
            for kind, own in ((0, ~hot), (1, hot)):
                x, y, z, c = added(v[own], u[own], w[own], np.ones(int(own.sum()), np.int64))
                out += [(kind, b, packed_trigrams(x[i], y[i], z[i], c[i])) for b, i in by_range(place(x, y, np.full(len(x), bool(kind)), n))]
            yield blobs(out)

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        none = (np.zeros(0, np.int64),) * 4
        kinds = [added(*map(np.concatenate, zip(none, *map(unpacked_trigrams, held.pop(k, [])), strict=True))) for k in (0, 1)]
        v, u, w, c = map(np.concatenate, zip(*kinds, strict=True))  # a middle word is in one of them only
        save_table(path, "tri", bucket, hash3(u, v, w), c, c)
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(v)])
        add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else x[:0]
        save_table(path, "ctx", bucket, hash2(u[first], v[first]), total := add(c), total, add(c == 1), add(c == 2), add(c > 2))
        yield blobs([(0, 0, numbers_of(len(v), c, 0, c[:0]))])
        for hot, (v, _, w, c) in enumerate(kinds):
            order = np.lexsort((w, v))
            v, w, c = v[order], w[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])[: len(v)])
            left = np.diff(np.append(first, len(v)))
            if len(first):
                left = np.where(v[first] == _BEGIN, np.add.reduceat(c, first), left)
            v, w = v[first], w[first]
            if not hot:
                yield from pairs_done(words, bucket, "pair", v, w, left)
            elif len(v):
                yield blobs([(2, b, pack(planes(v[i]), planes(w[i]), _least(left[i]))) for b, i in by_range(place(v, w, np.ones(len(v), bool), n))])

    return materialize(reduce_blobs(docs.select("text").mapInArrow(count, BLOBS), n, BLOBS, store), "trigram-sums")[0]


def numbers_of(n_tri: int, c: np.ndarray, n_pair: int, left: np.ndarray) -> bytes:
    """Types and how many occur 1, 2, 3, 4 times, of trigrams and of pairs."""
    return ",".join(map(str, [n_tri, *(int((c == i).sum()) for i in (1, 2, 3, 4)), n_pair, *(int((left == i).sum()) for i in (1, 2, 3, 4))])).encode()


def pairs_done(words: Words, bucket: int, name: str, v: np.ndarray, w: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stores complete pairs in the order of v, and sends what they say of their words."""
    n = words.n
    save_table(words.path, name, bucket, hash2(v, w), left, left)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
    add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else x[:0].astype(np.int64)
    before, times = np.unique(w, return_counts=True)
    word = np.concatenate([v[first], before])
    none = np.zeros(len(before), np.int64)
    sums = [np.concatenate([add(x), none]) for x in (left, left == 1, left == 2, left > 2)] + [np.concatenate([np.zeros(len(first), np.int64), times])]
    out = [(0, 0, numbers_of(0, left[:0], len(v), left))]
    out += [(1, b, pack(planes(word[i]), *(_least(x[i]) for x in sums))) for b, i in by_range((word % n).astype(np.int32 if n > 1 << 15 else np.int16))]
    yield blobs(out)


def save_table(path: str, name: str, bucket: int, key: np.ndarray, size: np.ndarray, *values: np.ndarray) -> None:
    """Keys of size 1 and the others, these with values; each sorted, their leading bits as an index of blocks of about 16."""
    for kind, which in (("one", size == 1), ("many", size > 1)):
        own = key[which]
        order = np.argsort(own)
        own = own[order]
        bits = max(1, len(own).bit_length() - 4)
        at = np.searchsorted(own >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        rest = (own << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        put = [_least(v[which][order]) for v in values] if kind == "many" else []
        save_arrays(f"{path}/{name}-{kind}-{bucket}-key.npy", _least(at), rest, *put)


def find(path: str, name: str, bucket: int, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where keys stand in a table, -1 where they don't, and the table's values."""
    at, rest, *values = open_arrays(f"{path}/{name}-{bucket}-key.npy")
    if not len(rest) or not len(key):
        return np.full(len(key), -1, np.int64), values
    bits = (len(at) - 1).bit_length() - 1
    block = (key >> np.uint64(64 - bits)).astype(np.int64)
    want = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    lo, hi = at[block].astype(np.int64), at[block + 1].astype(np.int64)
    end, last = hi, len(rest) - 1
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        less = (rest[np.minimum(mid, last)] < want) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    return np.where((lo < end) & (rest[np.minimum(lo, last)] == want), lo, -1), values


# ---------------------------------------------------------------- the model

@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that every scorer needs."""

    words: Words
    discounts: tuple[tuple[float, ...], ...]  # of trigrams, pairs, words
    begin: tuple[int, int, int, int]  # total and classes of the begin symbol as a context
    classes: tuple[int, int, int]  # words with 1, 2, 3+ different words before
    pair_types: int

    @property
    def train_tokens(self) -> int:
        return self.words.train_tokens


def train(docs: DataFrame, hot_word: int = HOT, flush: int = FLUSH) -> Model:
    """Counts and stores the model of the texts of docs."""
    n = buckets_for(docs)
    path = local_path(new_path(docs.sparkSession, "word-lm"))
    words = count_words(docs, n, path, hot_word, flush)

    def hot(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [(unplanes(v), unplanes(w), c.astype(np.int64)) for v, w, c in map(unpack, held.get(2, []))]
        v, w, c = map(np.concatenate, zip((np.zeros(0, np.int64),) * 3, *parts, strict=True))
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])[: len(v)])
        yield from pairs_done(words, bucket, "hot", v[first], w[first], np.add.reduceat(c[order], first) if len(first) else c)

    def side(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        size = len(open_arrays(f"{path}/word-{bucket}.npy")[0])
        sums, begin = np.zeros((5, size), np.int64), np.zeros(5, np.int64)
        for word, *cols in map(unpack, held.get(1, [])):
            word = unplanes(word)
            own = word != _BEGIN
            at = word[own] // n
            for k, x in enumerate(cols):
                np.add.at(sums[k], at, x[own].astype(np.int64))
                begin[k] += int(x[~own].sum())
        save_arrays(f"{path}/side-{bucket}.npy", *map(_least, sums))
        left = sums[4]
        yield pa.RecordBatch.from_pydict({"x": [[*begin[:4].tolist(), *(int((left == i).sum()) for i in (1, 2, 3, 4)), int((left > 2).sum())]]})

    sums = count_trigrams(words, docs, flush)
    hots, _ = materialize(reduce_blobs(sums.filter("kind = 2"), n, BLOBS, hot), "hot-pairs")
    both = sums.filter("kind < 2").unionByName(hots)
    sided, _ = materialize(reduce_blobs(both.filter("kind = 1"), n, "x array<long>", side), "side-stats")
    numbers = lambda df, k: [int(x or 0) for x in df.agg(*(F.sum(F.element_at("x", i + 1)) for i in range(k))).first()]
    three = numbers(both.filter("kind = 0").select(F.split(F.decode("data", "UTF-8"), ",").cast("array<long>").alias("x")), 10)
    s = numbers(sided, 9)
    return Model(words, (tuple(discounts(three[1:5])), tuple(discounts(three[6:])), tuple(discounts(s[4:8]))), tuple(s[:4]), (s[4], s[5], s[8]), three[5])


def _class(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c - d[np.minimum(c, 3)]).clip(0)


def log10_probabilities(model: Model, hashes: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability, and its count in training."""
    words = model.words
    path, n = words.path, words.n
    number, count, u, v, w = contexts(words, hashes, rows)
    hot = count > words.hot
    d3, d2, d1 = map(np.array, model.discounts)
    # words
    side = np.zeros((5, len(number)), np.int64)
    side[:4, -1] = model.begin
    known = np.flatnonzero(number < _NONE)
    for b, i in by_range((number[known] % n).astype(np.int32 if n > 1 << 15 else np.int16)):
        i = known[i]
        at = number[i] // n
        for k, x in enumerate(open_arrays(f"{path}/side-{b}.npy")):
            side[k, i] = x[at]
    types = model.pair_types
    one = 1 / (words.vocabulary + 1)
    low = _class(d1, side[4]) / types + (d1[1:] @ np.array(model.classes)) / types * one if types else np.full(len(number), one)
    p = low[w]
    total, n1, n2, n3 = side[:4]
    share = (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(total, 1)
    # pairs of hot words, dealt by the second one
    left = np.zeros(len(w), np.int64)
    seen = np.flatnonzero((hot & (total > 0))[v] & (number < _NONE)[w])
    key = hash2(number[v[seen]], number[w[seen]])
    for b, i in by_range(leading(key, n)):
        left[seen[i]] = value(path, "hot", b, key[i])
    # the other pairs, and trigrams: these stand in one range unless the middle word is hot
    seen = np.flatnonzero((total > 0)[v])
    bucket = leading(mix(_u(number) + _C3), n)[v[seen]]
    dealt = np.flatnonzero(hot[v[seen]])
    bucket[dealt] = leading(hash2(number[v[seen[dealt]]], number[u[seen[dealt]]]), n)
    for b, i in by_range(bucket):
        i = seen[i]
        x, y, z = number[u[i]], number[v[i]], number[w[i]]
        c = left[i]
        own = np.flatnonzero(~hot[v[i]] & (z < _NONE))
        c[own] = value(path, "pair", b, hash2(y[own], z[own]))
        p[i] = _class(d2, c) / total[v[i]] + share[v[i]] * p[i]
        own = np.flatnonzero(x != _NONE)
        key = hash2(x[own], y[own])
        order = np.argsort(key)
        own, key = own[order], key[order]
        sums = np.zeros((4, len(own)), np.int64)
        once = find(path, "ctx-one", b, key)[0] >= 0
        sums[:2, once] = 1
        rest = np.flatnonzero(~once)
        at, values = find(path, "ctx-many", b, key[rest])
        rest, at = rest[at >= 0], at[at >= 0]
        for k, a in enumerate(values):
            sums[k, rest] = a[at]
        own, (t, n1, n2, n3) = own[sums[0] > 0], sums[:, sums[0] > 0]
        c = value(path, "tri", b, hash3(x[own], y[own], z[own]))
        i = i[own]
        p[i] = _class(d3, c) / t + (d3[1] * n1 + d3[2] * n2 + d3[3] * n3) / t * p[i]
    return np.log10(p), count[w]


def value(path: str, name: str, bucket: int, key: np.ndarray) -> np.ndarray:
    """Values of keys, 0 where there is none."""
    out = (find(path, f"{name}-one", bucket, key)[0] >= 0).astype(np.int64)
    rest = np.flatnonzero(out == 0)
    at, (values,) = find(path, f"{name}-many", bucket, key[rest])
    hit = at >= 0
    out[rest[hit]] = values[at[hit]]
    return out


def score(docs: DataFrame, model: Model, held_out: str, limit: int = STEP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    n, v = model.train_tokens, model.words.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        for parts, hashes, rows in gathered(batches, limit, "doc_id", "held_out"):
            lp, c = log10_probabilities(model, hashes, rows)
            at = rows[:-1]
            base = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.concat_arrays([x.column(0) for x in parts]),
                "held_out": pa.concat_arrays([x.column(1) for x in parts]),
                "n_tokens": pa.array(np.diff(rows)),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(at), n, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(lp, at)),
            })
        leave()

    return docs.select("doc_id", "text", F.expr(held_out).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    held_out = "crc32(cast(coalesce(cast(doc_id as string), 'null') as binary)) % 7 = 2"
    return score(docs, train(docs.filter(f"not ({held_out})")), held_out)

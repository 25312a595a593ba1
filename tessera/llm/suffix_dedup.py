"""Exact substring deduplication of bytes by a common-prefix-aware distributed merge sort of suffixes.

Equal strings of ``window`` bytes hold the same least k-gram at the same offset, so only suffixes that start at such
anchors are sorted, about one for every 170 bytes, and of those only the ones whose k-gram occurs twice in the corpus at all (a
hash filter). A mapper sorts its suffixes by range into runs, equal ones once, and sends each run front-coded: the length
of the prefix shared with the suffix before, then the rest. A range's task merges the runs with a loser tree that carries
the common prefixes along: of two heads the one with the longer known prefix is the smaller; where they are equal,
bytes are compared from there on, so no known prefix is read again. The merged order and its common prefixes, with the text left of each
anchor, say which windows around it have an equal elsewhere. Outcomes are kept by the content's hash in memory-mapped sorted arrays, and each
document looks up its own anchors; neither documents nor lists of members ever move.

An anchor found over HOT times (a passage or copy in a large share of the documents) would bring many different surroundings
to one range. Around such anchors every window is sent by its own hash instead, so these are spread evenly; that
way compares 64-bit hashes, all others compare bytes.

With ``short``, the same scans also search with that smaller window and count the bytes it finds (n_repeated); shorter repeats stay in the text.

Edge cases: null and empty texts have no bytes and one empty kept text; texts below a window stay whole; repeated rows are
each other's copies and lose everything that is a window long; doc_id (null too) is carried along only; very long texts are
searched in segments; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, Rolling, blobs, buckets_for, local_path, materialize, minima, mix, new_path, over, reduce_blobs, split_by_bucket, steps, text_bytes
from tessera.llm.keyfiles import FLUSH, KeyFiles, open_array, pack, repeated, save_array, unpack

WINDOW, GRAM = 400, 64
#: Smaller window of the query: passages of over 50 words are longer in all four languages.
SHORT = 250
#: Occurrences of an anchor from which its windows are sent one by one.
HOT = 1000
#: Window starts searched at once within a long text.
SEGMENT = 2 << 20
#: Text of the suffixes that a mapper sorts at once.
RUN_BYTES = 48 << 20
#: Groups up to so many different surroundings are compared in pairs, larger ones offset by offset.
PAIRS = 8


class Anchors:
    """Anchors of the windows of one length that start in a segment: anchor p serves the windows from s1 to s2."""

    def __init__(self, seg: Segment, window: int):
        self.window, self.sums = window, seg.sums
        low = minima(seg.grams, window - seg.gram + 1)[: seg.starts]
        s = np.arange(len(low))
        s = s[seg.row_end[: len(low)] >= s + seg.lo + window]
        p = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])) if len(s) else np.zeros(0, np.int64)
        self.p, self.s1, self.s2 = p[new], s[new], s[np.append(new[1:], len(s)) - 1] if len(s) else s
        self.key = mix(seg.hashes[self.p] + np.uint64(1))  # least hashes share their leading bits: spread again

    def contents(self, i: np.ndarray) -> np.ndarray:
        """A hash of the surroundings of anchors and the anchors' places in them."""
        return mix(self.sums.slices(self.s1[i], self.s2[i] + self.window) + (self.p[i] - self.s1[i]).astype(np.uint64))

    def windows(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of anchors."""
        n = self.s2[i] - self.s1[i] + 1
        s = np.repeat(self.s1[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return s, self.sums.slices(s, s + self.window)


class Segment:
    """Hashes of data[lo:hi] and of what windows that start there reach; ``by[window]`` its anchors."""

    def __init__(self, data: np.ndarray, lo: int, hi: int, row_end: np.ndarray, lengths: tuple[int, ...], gram: int):
        self.lo, self.starts, self.row_end, self.gram = lo, hi - lo, row_end[lo:hi], gram
        self.data = part = data[lo : hi + max(lengths) - 1]
        self.sums = Rolling(part)
        at = np.arange(max(0, len(part) - gram + 1))
        self.hashes = self.sums.slices(at, at + gram)
        self.grams = (self.hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        self.by = {w: Anchors(self, w) for w in lengths}
        del self.grams


def segments(data: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...], gram: int, segment: int = SEGMENT) -> Iterator[Segment]:
    """Whole documents together up to a segment's length, longer ones in pieces from their own start on: what surrounds an
    anchor depends on its document alone, not on how the table is read."""
    row_end = np.repeat(offs[1:], np.diff(offs))
    cuts, lo = [], 0
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a > segment or b - lo > segment:
            if a > lo:
                cuts.append((lo, a))
            lo = a
        if b - a > segment:
            cuts += [(x, min(x + segment, b)) for x in range(a, b, segment)]
            lo = b
    cuts.append((lo, len(data)))
    for lo, hi in cuts:
        got = Segment(data, lo, hi, row_end, lengths, gram)
        if any(len(x.p) for x in got.by.values()):
            yield got


def common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix, known to be at least at."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefixes with the string before, lengths, and what remains of each."""
    shared, before = [], b""
    for s in strings:
        shared.append(common(before, s, 0))
        before = s
    rest = b"".join([s[h:] for s, h in zip(strings, shared, strict=True)])
    return np.array(shared, np.uint32), np.array([len(s) for s in strings], np.uint32), np.frombuffer(rest, np.uint8)


def front_decode(shared: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> Iterator[tuple[bytes, int]]:
    raw, at, before = rest.tobytes(), 0, b""
    for h, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:h] + raw[at : at + n - h]
        at += n - h
        yield before, h


class LoserTree:
    """Merges sorted runs of (string, common prefix with the one before in its run, value).

    ``known[i]``: how much of run i's head is shared with the string put out last (at the nodes on its path; with the
    local winner elsewhere).
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[bytes | None] = [None] * self.k
        self.value: list[object] = [None] * self.k
        self.known = [0] * self.k
        for i in range(len(runs)):
            self._next(i)
            self.known[i] = 0
        self.loser = [0] * self.k
        self.winner = self._build(1)

    def _next(self, i: int) -> None:
        got = next(self.runs[i], None)
        if got is None:
            self.head[i] = None
        else:
            self.head[i], self.known[i], self.value[i] = got

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b, known = self.head[i], self.head[j], self.known
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        n = common(a, b, known[i])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        w, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        """Strings in order, each with its common prefix with the one before."""
        w = self.winner
        while self.head[w] is not None:
            yield self.head[w], self.known[w], self.value[w]
            self._next(w)
            node = (w + self.k) >> 1
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node >>= 1


def resolve(group: list[tuple[bytes, int, bytes, bool, int]], window: int, pairs: int = PAIRS) -> Iterator[tuple[int, int, int]]:
    """(content, lo, hi) for the windows that start lo to hi bytes left of an anchor and have an equal elsewhere.

    group: suffixes with one k-gram in order: (right, common prefix with the one before, left reversed, found twice, content).
    """
    classes: list[list] = []  # right, prefix, left, twice, content
    i = 0
    while i < len(group):
        j = i + 1
        while j < len(group) and group[j][1] == len(group[j][0]) == len(group[i][0]):
            j += 1
        by_left: dict[bytes, list] = {}
        for right, known, left, twice, content in group[i:j]:
            if left in by_left:
                by_left[left][3] = True
            else:
                by_left[left] = [right, known, left, twice, content]
        same = list(by_left.values())
        same[0][1] = group[i][1]
        for c in same[1:]:
            c[1] = len(c[0])
        classes += same
        i = j
    found: list[list[tuple[int, int]]] = [[(window - len(c[0]), len(c[2]))] if c[3] else [] for c in classes]
    if len(classes) <= pairs:
        for a in range(len(classes)):
            r = len(classes[a][0])
            for b in range(a + 1, len(classes)):
                r = min(r, classes[b][1])
                lo, hi = window - r, common(classes[a][2], classes[b][2], 0)
                if lo <= hi:
                    found[a].append((lo, hi))
                    found[b].append((lo, hi))
    else:
        for o in range(min(window - len(c[0]) for c in classes), max(len(c[2]) for c in classes) + 1):
            seen: dict[tuple[bytes, bytes], int] = {}
            for k, c in enumerate(classes):
                if window - len(c[0]) <= o <= len(c[2]):
                    other = seen.setdefault((c[0][: window - o], c[2][:o]), k)
                    if other != k:
                        for x in (other, k):
                            if found[x] and found[x][-1][1] >= o - 1 and found[x][-1][0] <= o:
                                found[x][-1] = (found[x][-1][0], max(o, found[x][-1][1]))
                            else:
                                found[x].append((o, o))
    for c, intervals in zip(classes, found, strict=True):
        for lo, hi in sorted(set(intervals)):
            yield c[4], lo, hi


def merge(pieces: list[bytes], window: int, gram: int, pairs: int = PAIRS) -> Iterator[tuple[int, int, int]]:
    """Merges the runs of a range and resolves one group of equal k-grams after the other."""

    def run(x: bytes) -> Iterator[tuple[bytes, int, object]]:
        rs, rn, rr, ls, ln, lr, twice, content = unpack(x)
        rest = zip(front_decode(ls, ln, lr), np.unpackbits(twice, count=len(rs)).tolist(), content.tolist(), strict=True)
        for (right, known), ((left, _), two, c) in zip(front_decode(rs, rn, rr), rest, strict=True):
            yield right, known, (left, bool(two), c)

    group: list[tuple[bytes, int, bytes, bool, int]] = []
    for right, known, (left, twice, content) in LoserTree([run(x) for x in pieces]):
        if group and known < gram:
            if len(group) > 1 or group[0][3]:
                yield from resolve(group, window, pairs)
            group = []
        group.append((right, known, left, twice, content))
    if group:
        yield from resolve(group, window, pairs)


def repeats(docs: DataFrame, anchors: KeyFiles, n: int, lengths: tuple[int, ...], gram: int, segment: int = SEGMENT, pairs: int = PAIRS) -> str:
    """Sorts and merges the suffixes at repeated anchors, for each length of windows; returns the path of what was found."""
    path = local_path(new_path(docs.sparkSession, "suffixes"))

    def runs(kind: int, held: list[tuple[int, bytes, bytes, int]]) -> list[tuple[int, int, bytes]]:
        held.sort()
        out, i = [], 0
        while i < len(held):
            b, rights, lefts, twice, contents = held[i][0], [], [], [], []
            while i < len(held) and held[i][0] == b:
                _, right, left, content = held[i]
                if rights and rights[-1] == right and lefts[-1] == left:
                    twice[-1] = True
                else:
                    rights.append(right)
                    lefts.append(left)
                    twice.append(False)
                    contents.append(content)
                i += 1
            out.append((kind, b, pack(*front_code(rights), *front_code(lefts), np.packbits(np.array(twice)), np.array(contents, np.uint64))))
        return out

    def hot(kind: int, held: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        h = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many, h = np.diff(np.append(first, len(h))) > 1, h[first]
        return [(kind, b, pack(np.diff(h[s], prepend=np.uint64(0)), np.packbits(many[s]))) for b, s in split_by_bucket(h, n)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in lengths]
        windows: list[list[np.ndarray]] = [[] for _ in lengths]
        size, n_windows = [0] * len(lengths), [0] * len(lengths)
        shift = np.uint64(65 - n.bit_length())
        for batch in batches:
            for part in steps(batch):
                data, offs = text_bytes(part.column(0))
                for seg in segments(data, offs, lengths, gram, segment):
                    raw = seg.data.tobytes()
                    for k, (window, own) in enumerate(seg.by.items()):
                        i = np.flatnonzero(anchors.find(own.key))
                        is_hot = anchors.find(own.key[i], "hot")
                        if is_hot.any():
                            windows[k].append(own.windows(i[is_hot])[1])
                            n_windows[k] += len(windows[k][-1])
                        i = i[~is_hot]
                        for b, p, s1, e, c in zip((own.key[i] >> shift).tolist(), own.p[i].tolist(), own.s1[i].tolist(), (own.s2[i] + window).tolist(), own.contents(i).tolist(), strict=True):
                            held[k].append((b, raw[p:e], raw[s1:p][::-1], c))
                            size[k] += e - s1
                for k in range(len(lengths)):
                    if size[k] > RUN_BYTES // len(lengths):
                        yield blobs(runs(2 * k, held[k]))
                        held[k], size[k] = [], 0
                    if n_windows[k] > FLUSH // len(lengths):
                        yield blobs(hot(2 * k + 1, windows[k]))
                        windows[k], n_windows[k] = [], 0
        for k in range(len(lengths)):
            if held[k]:
                yield blobs(runs(2 * k, held[k]))
            if n_windows[k]:
                yield blobs(hot(2 * k + 1, windows[k]))

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        for i, window in enumerate(lengths):
            found = np.array(list(merge(held.pop(2 * i, []), window, gram, pairs)), np.uint64).reshape(-1, 3)
            found = found[np.argsort(found[:, 0], kind="stable")]
            for k, (name, kind) in enumerate((("content", np.uint64), ("lo", np.uint32), ("hi", np.uint32))):
                save_array(f"{path}/{window}-{name}-{bucket}.npy", found[:, k].astype(kind))
            keys = []
            for x in held.pop(2 * i + 1, []):
                step, many = unpack(x)
                h = np.cumsum(step, dtype=np.uint64)
                keys += [h, h[np.unpackbits(many, count=len(h)).astype(bool)]]
            h = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            save_array(f"{path}/{window}-window-{bucket}.npy", np.unique(h[1:][h[1:] == h[:-1]]))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(found)], pa.int64())})

    materialize(reduce_blobs(docs.select("text").mapInArrow(emit, BLOBS), n, "n long", store), "suffixes")
    return path


def _look_up(anchors: Anchors, i: np.ndarray, path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of repeated windows around anchors i."""
    content, starts, ends = anchors.contents(i), [], []
    order = np.argsort(anchors.key[i])
    for b, s in split_by_bucket(anchors.key[i][order], n):
        own = open_array(f"{path}/{anchors.window}-content-{b}.npy")
        if not len(own):
            continue
        q = order[s]
        left, right = np.searchsorted(own, content[q]), np.searchsorted(own, content[q], "right")
        many = right - left
        at = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
        p = np.repeat(anchors.p[i][q], many)
        starts.append(p - open_array(f"{path}/{anchors.window}-hi-{b}.npy")[at].astype(np.int64))
        ends.append(p - open_array(f"{path}/{anchors.window}-lo-{b}.npy")[at].astype(np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none)


@dataclass(frozen=True)
class Repeats:
    """Where the outcome of a search lies."""

    anchors: KeyFiles
    path: str
    n: int
    lengths: tuple[int, ...]
    gram: int
    segment: int

    def covered(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """For each length of windows and each byte whether a repeated one covers it."""
        edges = [np.zeros(len(data) + 1, np.int32) for _ in self.lengths]
        for seg in segments(data, offs, self.lengths, self.gram, self.segment):
            for edge, (window, own) in zip(edges, seg.by.items(), strict=True):
                i = np.flatnonzero(self.anchors.find(own.key))
                is_hot = self.anchors.find(own.key[i], "hot")
                a, z = _look_up(own, i[~is_hot], self.path, self.n)
                if is_hot.any():
                    s, h = own.windows(i[is_hot])
                    order = np.argsort(h)
                    hit = np.zeros(len(h), bool)
                    for b, part in split_by_bucket(h[order], self.n):
                        known = open_array(f"{self.path}/{window}-window-{b}.npy")
                        if len(known):
                            q = order[part]
                            hit[q] = known[np.minimum(np.searchsorted(known, h[q]), len(known) - 1)] == h[q]
                    a, z = np.concatenate([a, s[hit]]), np.concatenate([z, s[hit]])
                np.add.at(edge, a + seg.lo, 1)
                np.add.at(edge, z + seg.lo + window, -1)
        return [np.cumsum(edge[:-1]) > 0 for edge in edges]


def search(docs: DataFrame, n: int, lengths: tuple[int, ...], gram: int | None = None, hot: int = HOT, segment: int = SEGMENT, pairs: int = PAIRS) -> Repeats:
    """Finds the windows of these lengths that occur twice or more in the texts of docs, in one scan each to count, sort and look up.

    The anchors of a length are among those of each smaller one, so the smallest's say which may be repeated.
    """
    least = min(lengths)
    gram = min(GRAM, max(1, least // 2)) if gram is None else gram

    def hashes(part: pa.RecordBatch) -> np.ndarray:
        keys = [seg.by[least].key for seg in segments(*text_bytes(part.column(0)), (least,), gram, segment)]
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64)

    anchors = repeated(docs, ["text"], hashes, n, "anchors", hot=hot)
    return Repeats(anchors, repeats(docs, anchors, n, lengths, gram, segment, pairs), n, lengths, gram, segment)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int | None = None, hot: int = HOT, segment: int = SEGMENT, pairs: int = PAIRS, texts: bool = False, short: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with short n_repeated, and with texts the kept bytes (kept)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = buckets_for(docs)
    if short and short >= window:
        raise ValueError("short must be below window")
    found = search(docs, n, (window, short) if short else (window,), gram, hot, segment, pairs)

    def run(part: pa.RecordBatch) -> dict:
        data, offs = text_bytes(part.column(1))
        gone, *rest = found.covered(data, offs)
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = offs[:-1][offs[:-1] < len(gone)]
        first[inner] = gone[inner]
        raw, kept, total = data.tobytes(), [], np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(first)])
        n_gone = total[offs[1:]] - total[offs[:-1]]
        for a, b, g in zip(offs[:-1].tolist(), offs[1:].tolist(), n_gone.tolist(), strict=True):
            kept.append(data[a:b][~gone[a:b]].tobytes() if g else raw[a:b])
        out = {"doc_id": part.column(0), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(spans[offs[1:]] - spans[offs[:-1]], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if rest:
            total = np.concatenate([[0], np.cumsum(rest[0])])
            out["n_repeated"] = pa.array(total[offs[1:]] - total[offs[:-1]], pa.int64())
        return out | ({"kept": pa.array(kept, pa.binary())} if texts else {})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(short) + ", kept binary" * texts
    return over(docs, ["doc_id", "text"], schema, run)


def op1(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=SHORT)

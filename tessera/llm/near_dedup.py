"""Near-duplicate groups by Order MinHash over five-word shingles, verified by banded alignment.

Texts with one sequence of words are one class, by 128 bits of hash; only classes go on. Each of BANDS functions hashes a text's
shingles, labelled with their occurrence, and keeps the PICK least in the order of the text: their hash is the text's
bucket in that band. Texts that share their order too meet, so the sketch is sensitive to edit similarity; a pair of
similarity 0.8 meets in no band with probability 0.0002 if its texts are long, 0.0015 at 8 of 10 shingles. Texts of FEW shingles at most
also meet by their sets less one shingle, which loses no pair of them.

A bucket's members are compared with its leader, the least by a hash of bucket and class, so leaders differ between buckets. Members that the leader
is not similar to stay behind. They are compared with the members that joined it, but for those of a Jaccard similarity below
0.6 to the leader, which by the triangle inequality are similar to none that joined, and with each other. Where more than LEFT_OVER
stay behind, they get a next leader in another distributed round as long as leaders take half; after that only those not yet in one component
are compared. Comparisons are dealt by pairs of blocks of about BLOCK members, and within a task go by an inverted index of shingles that skips
what is connected already, so all members of a bucket that are similar end in one component. No bucket's pairs are ever listed and none is capped. Two
texts are linked if their sets of shingles have a Jaccard similarity of at least 0.8 and a banded alignment of their words finds
an edit similarity of at least 0.8. Sequences of words lie in memory-mapped files by class. Groups are the
connected components of the links, by alternating large and small stars over tables.

Edge cases: null and empty texts have no words and are copies of each other; a text of fewer than five words is one shingle; a null
doc_id never names a group while another is there; repeated rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, MAX_PARTITIONS, Rolling, blobs, buckets_for, enter, keyed_join, local_path, materialize, mix, new_path, over, reduce_blobs, split_by_bucket, steps, text_bytes, wide, words
from tessera.llm.keyfiles import open_array, pack, save_array, unpack

SHINGLE, SIMILARITY = 5, 0.8
BANDS, PICK = 16, 4
#: Members of a bucket left over by its leaders that are finished at once, in blocks.
LEFT_OVER = 2000
#: Members of a block: two blocks meet in one task.
BLOCK = 250
#: Texts of so many different shingles at most also meet by their sets: two of them at 0.8 differ by one shingle.
FEW = 9
#: Least shingles of a text that are looked at for each function, about; texts where too few are found are looked at whole.
_NEAR = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 2 << 20
#: Shingles that an index within a task holds, about.
_INDEX = 1 << 20


def sequences(part: pa.RecordBatch, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and offsets of the rows, and two hashes of each row's sequence."""
    data, offs = text_bytes(part.column(part.schema.get_field_index("text")))
    start, end, before = words(data, offs)
    word = Rolling(data).slices(start, end) if len(start) else np.zeros(0, np.uint64)
    a = Rolling(word).slices(before[:-1], before[1:])
    b = Rolling(word, base=0x2545F4914F6CDD1D).slices(before[:-1], before[1:])
    return word, before, mix(a + np.uint64(salt) * mix(b)) if salt else a, b


def shingles(word: np.ndarray, before: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and offsets of the rows; a row of fewer words has one, of all its words."""
    n = np.diff(before)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(offs[-1]) - np.repeat(offs[:-1] - before[:-1], count)
    end = np.minimum(start + k, np.repeat(before[1:], count))
    return Rolling(word).slices(start, end) if len(start) else np.zeros(0, np.uint64), offs


def occurrences(sh: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each shingle has stood before in its row."""
    key = mix(sh + mix(row.astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    out = np.zeros(len(sh), np.int64)
    if same.any():
        at = np.arange(len(sh))
        out[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return out


def bands(word: np.ndarray, before: np.ndarray, n_bands: int = BANDS, pick: int = PICK) -> np.ndarray:
    """The buckets of each row, one a band; rows without words have zeros."""
    sh, offs = shingles(word, before)
    n = np.diff(offs)
    out = np.zeros((len(n), n_bands), np.uint64)
    if not len(sh):
        return out
    row = np.repeat(np.arange(len(n)), n)
    labelled = mix(sh ^ (occurrences(sh, row).astype(np.uint64) * _ODD))
    share = np.minimum(1.0, _NEAR / np.maximum(n, 1))
    limit = np.where(share < 1, share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)[row]
    want = np.minimum(n, pick)
    for f in range(n_bands):
        x = labelled * np.uint64(2 * int(mix(np.array([f + 1], np.uint64))[0] >> np.uint64(1)) + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        near = np.flatnonzero(x <= limit)
        found = np.bincount(row[near], minlength=len(n))
        short = np.flatnonzero(found < want)
        if len(short):
            near = np.flatnonzero((x <= limit) | np.isin(row, short))
        order = near[np.lexsort((near, x[near], row[near]))]
        r = row[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        order = np.sort(order[rank < pick])  # the least ones, in the order of the text
        r = row[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        h = np.full(len(n), f + 1, np.uint64)
        for j in range(pick):
            at = order[rank == j]
            h[row[at]] = mix(h[row[at]] * _ODD + sh[at])
        out[:, f] = np.where(n > 0, h, np.uint64(0))
    return out


def short_sets(word: np.ndarray, before: np.ndarray) -> dict[int, np.ndarray]:
    """More buckets for rows of FEW different shingles at most: their set, and it without each of its shingles. A pair at 0.8 among such
    rows has one set that holds the other and one shingle more at most, so it meets for certain."""
    sh, offs = shingles(word, before)
    out = {}
    n = np.diff(offs)
    for i in np.flatnonzero((n > 0) & (n <= 4 * FEW)).tolist():
        own = mix(np.unique(sh[offs[i] : offs[i + 1]]))
        if len(own) <= FEW:
            total = own.sum(dtype=np.uint64)
            out[i] = mix(np.concatenate([[total], total - own]) ^ _ODD)
    return out


# ---------------------------------------------------------------- verification

def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the edit distance of two sequences is at most limit: furthest-reaching points on the diagonals of a band."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False

    def slide(x: int, y: int) -> int:
        """How far a[x:] and b[y:] agree."""
        size, done = 32, 0
        end = min(n - x, m - y)
        while done < end:
            k = min(size, end - done)
            odd = a[x + done : x + done + k] != b[y + done : y + done + k]
            i = int(odd.argmax())
            if odd[i]:
                return done + i
            done += k
            size *= 4
        return end

    reach = {0: slide(0, 0)}
    if reach[0] >= n and n == m:
        return True
    for e in range(1, limit + 1):
        now: dict[int, int] = {}
        for k in range(max(-e, -limit, -n), min(e, limit, m) + 1):  # diagonal y - x
            x = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            x = min(x, n, m - k)
            if x < 0 or x + k < 0:
                continue
            x += slide(x, x + k)
            if x >= n and x + k >= m:
                return True
            now[k] = x
        reach = now
    return False


class Sequences:
    """The stored classes: words (32 bits of hash each) and sets of shingles."""

    def __init__(self, path: str, n: int):
        self.path, self.n = path, n
        self.sets = functools.lru_cache(maxsize=256)(self._set)

    def words(self, cid: int) -> np.ndarray:
        b = cid >> (65 - self.n.bit_length())
        at = int(np.searchsorted(open_array(f"{self.path}/cid-{b}.npy"), np.uint64(cid)))
        offs = open_array(f"{self.path}/offs-{b}.npy")
        return open_array(f"{self.path}/word-{b}.npy")[offs[at] : offs[at + 1]]

    def _set(self, cid: int) -> np.ndarray:
        w = self.words(cid).astype(np.uint64)
        return np.unique(shingles(w, np.array([0, len(w)]))[0])

    def jaccard(self, p: int, q: int, least: float) -> float:
        """Of the sets of shingles; 0 if their sizes tell that it is below least."""
        a, b = self.sets(p), self.sets(q)
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            return 0.0
        both = np.concatenate([a, b])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared / (len(a) + len(b) - shared)

    def aligned(self, p: int, q: int, least: float = SIMILARITY) -> bool:
        x, y = np.asarray(self.words(p)), np.asarray(self.words(q))
        return within(x, y, int((1 - least) * max(len(x), len(y)) + 1e-9))

    def connect(self, own: list[int], label: np.ndarray, others: int, known: dict[tuple[int, int], bool]) -> Iterator[tuple[int, int]]:
        """Links that connect whatever is similar among own, or, if others is not 0, between own[:others] and own[others:].

        label: a number for each that is equal where two are connected already; it is kept up to date, and such pairs are skipped.
        """
        n = others or len(own)
        size = np.array([len(self.sets(c)) for c in own])
        lo = 0
        while lo < n:  # an index of bounded size: at least one member, about _INDEX shingles
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:n]), _INDEX, "right")) + lo)
            sh = np.concatenate([self.sets(c) for c in own[lo:hi]])
            order = np.argsort(sh, kind="stable")
            sh, member = sh[order], np.repeat(np.arange(hi - lo), size[lo:hi])[order]
            ask = np.arange(others or lo, len(own))
            if not others:  # those most like the rest first: they connect most
                per = np.searchsorted(sh, sh, "right") - np.searchsorted(sh, sh, "left")
                common = np.bincount(member, per, hi - lo) / size[lo:hi]
                ask = np.concatenate([lo + np.argsort(-common, kind="stable"), np.arange(hi, len(own))])
            todo = np.ones(hi - lo, bool)
            for q in ask.tolist():
                if not others and q < hi:
                    todo[q - lo] = False
                open_ = todo & (label[lo:hi] != label[q])
                if not open_.any():
                    continue
                mine = self.sets(own[q])
                left = np.searchsorted(sh, mine, "left")
                count = np.searchsorted(sh, mine, "right") - left
                found = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
                shared = np.bincount(member[found], minlength=hi - lo)
                for i in np.flatnonzero(open_ & (shared >= SIMILARITY * (size[lo:hi] + size[q] - shared))).tolist():
                    i += lo
                    if label[i] == label[q]:
                        continue
                    pair = (min(own[i], own[q]), max(own[i], own[q]))
                    if pair not in known:
                        known[pair] = self.aligned(*pair)
                    if known[pair]:
                        label[label == label[q]] = label[i]
                        yield own[i], own[q]
            lo = hi


def store_sequences(docs: DataFrame, wanted: DataFrame, n: int, salt: int) -> str:
    """Writes the words of the classes wanted (cid) by ranges of cid; returns the path."""
    path = local_path(new_path(docs.sparkSession, "sequences"))
    shift = np.uint64(65 - n.bit_length())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        at, held = None, []
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at and at is not None:
                    save_array(f"{path}/want-{at}.npy", np.sort(np.array(held, np.int64).view(np.uint64)))
                    yield pa.RecordBatch.from_pydict({"n": [len(held)]})
                    held = []
                at = b
                if c is not None:
                    held.append(c)
        if at is not None:
            save_array(f"{path}/want-{at}.npy", np.sort(np.array(held, np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"n": [len(held)]})

    bits = n.bit_length() - 1
    range_of = F.shiftrightunsigned("cid", 64 - bits).cast("int") if bits else F.lit(0)
    every = wanted.sparkSession.range(n).select(F.col("id").cast("int").alias("b"), F.lit(None).cast("long").alias("cid"))  # each range has its file
    materialize(wanted.select(range_of.alias("b"), "cid").unionByName(every).repartition(min(n, MAX_PARTITIONS), "b").sortWithinPartitions("b").mapInArrow(keys, "n long"), "wanted")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        sent: set[int] = set()
        for batch in batches:
            for part in steps(batch, limit=_STEP):
                word, before, cid, _ = sequences(part, salt)
                order = np.argsort(cid, kind="stable")
                out = []
                for b, s in split_by_bucket(cid[order], n):
                    own = open_array(f"{path}/want-{b}.npy")
                    if not len(own):
                        continue
                    q = order[s]
                    q = q[own[np.minimum(np.searchsorted(own, cid[q]), len(own) - 1)] == cid[q]]
                    new = [i for i in q.tolist() if not (int(cid[i]) in sent or sent.add(int(cid[i])))]
                    if new:
                        out.append((0, b, pack(cid[new], np.diff(before)[new], np.concatenate([word[before[i] : before[i + 1]] for i in new]).astype(np.uint32))))
                if out:
                    yield blobs(out)

    def store(bucket: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)]
        cid, size, data = map(np.concatenate, zip(none, *map(unpack, held.get(0, [])), strict=True))
        first = np.cumsum(size) - size
        cid, at = np.unique(cid, return_index=True)
        size, first = size[at], first[at]
        offs = np.concatenate([[0], np.cumsum(size)])
        save_array(f"{path}/word-{bucket}.npy", data[np.repeat(first - offs[:-1], size) + np.arange(offs[-1])])
        save_array(f"{path}/offs-{bucket}.npy", offs)
        save_array(f"{path}/cid-{bucket}.npy", cid)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(cid)], pa.int64())})

    del shift
    materialize(reduce_blobs(docs.select("text").mapInArrow(emit, BLOBS), n, "n long", store), "sequences")
    return path


def verify(pairs: DataFrame, path: str, n: int) -> DataFrame:
    """pairs (lead, cid) with whether they are similar (linked), and whether something similar to cid can be similar to lead too (near)."""
    far = 2 * SIMILARITY - 1  # Jaccard distances add up: two steps of 0.2 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        seq = Sequences(path, n)
        for batch in batches:
            p, q = (np.asarray(batch.column(i)).view(np.uint64).tolist() for i in (0, 1))
            like = [seq.jaccard(x, y, far - 1e-9) for x, y in zip(p, q, strict=True)]
            linked = [j >= SIMILARITY and seq.aligned(x, y) for x, y, j in zip(p, q, like, strict=True)]
            yield pa.RecordBatch.from_pydict({"lead": batch.column(0), "cid": batch.column(1), "linked": pa.array(linked, pa.bool_()), "near": pa.array([j >= far - 1e-9 for j in like], pa.bool_())})

    return wide(pairs.select("lead", "cid"), "lead", "cid").mapInArrow(run, "lead long, cid long, linked boolean, near boolean")


def finish(jobs: DataFrame, path: str, n: int) -> DataFrame:
    """Links (lead, cid) of the jobs: members (cid) of two blocks (i, j) of a bucket, on the sides 0 and 1, that are compared across, or of one
    block with each other if cross is false. Members of one root are connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        seq = Sequences(path, n)
        known: dict[tuple[int, int], bool] = {}

        def links_of(held: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            if len(known) > 20_000:
                known.clear()
            side, own, root = (list(x) for x in zip(*held, strict=True))
            cross, others = at[1], side.count(0)
            if cross and others in (0, len(own)):
                return
            label = np.unique(np.array(root), return_inverse=True)[1]
            out = list(seq.connect(own, label, others if cross else 0, known))
            if out:
                lead, cid = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"lead": lead, "cid": cid})

        at, held = None, []
        for batch in batches:
            cid = np.asarray(batch.column(5)).view(np.uint64).tolist()
            for b, cross, joined, i, j, c, root, side in zip(*(batch.column(k).to_pylist() for k in range(5)), cid, batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                if (b, cross, joined, i, j) != at:
                    if held:
                        yield from links_of(held)
                    at, held = (b, cross, joined, i, j), []
                held.append((side, c, root))
        if held:
            yield from links_of(held)

    dealt = wide(jobs.select("bucket", "cross", "joined", "i", "j", "cid", "root", "side"), "bucket", "cross", "joined", "i", "j").sortWithinPartitions("bucket", "cross", "joined", "i", "j", "side", F.xxhash64("cid", "bucket"))
    return dealt.mapInArrow(run, "lead long, cid long")


def _block(size: str, each: int) -> tuple:
    """Number of blocks of a side of so many members, and the block of a member."""
    blocks = F.ceil(F.col(size) / each).cast("int")
    return blocks, F.pmod(F.xxhash64("cid", F.lit(7)), blocks).cast("int")


def _others(blocks):
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def across(judged: DataFrame, each: int) -> DataFrame:
    """Jobs that compare those that joined their leader (linked; n_joined in the bucket) with those left over that may be similar to some (n_near)."""
    judged = judged.filter("n_joined > 0 and n_near > 0")
    (a, own_a), (b, own_b) = _block("n_joined", each), _block("n_near", each)
    put = ["bucket", F.lit(True).alias("cross"), F.lit(True).alias("joined")]
    joined = judged.filter("linked").select(*put, own_a.alias("i"), _others(b).alias("j"), "cid", F.col("lead").alias("root"), F.lit(0).alias("side"))
    near = judged.filter("not linked and near").select(*put, own_b.alias("j"), _others(a).alias("i"), "cid", F.col("cid").alias("root"), F.lit(1).alias("side"))
    return joined.unionByName(near)


def among(left: DataFrame, each: int) -> DataFrame:
    """Jobs that compare the left-overs (bucket, cid, root; n_left in the bucket) with each other."""
    blocks, own = _block("n_left", each)
    rows = left.filter("n_left > 1").select("bucket", "cid", "root", own.alias("_own"), _others(blocks).alias("_other"))
    cross = F.col("_own") != F.col("_other")
    return rows.select("bucket", cross.alias("cross"), F.lit(False).alias("joined"), F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "cid", "root", (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def links(classes: DataFrame, docs: DataFrame, n: int, salt: int, left_over: int = LEFT_OVER) -> DataFrame:
    """Verified links (lead, cid) between classes (cid, bands): they connect all classes that share a bucket and are similar."""
    rows, _ = materialize(classes.select("cid", F.explode("bands").alias("bucket")).filter("bucket <> 0").select("bucket", "cid"), "bands")
    links_, path, block = None, None, min(left_over, BLOCK)
    while True:
        # the leader is the least by a hash, with the class itself as its last part: a number, so it is aggregated in place
        mixed = rows.withColumn("_x", F.xxhash64("cid", "bucket"))
        groups, _ = materialize(mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("_x").alias("_lead")).filter("size > 1"), "buckets")
        members = keyed_join(mixed, groups, "bucket", rows.count(), "size")
        members, _ = materialize(members, "members")
        lead = members.filter("_x = _lead").groupBy("bucket").agg(F.min("cid").alias("lead"), F.first("size").alias("size"))
        lead, _ = materialize(lead, "leaders")
        led = keyed_join(members.select("bucket", "cid"), lead, "bucket", members.count(), "size").filter("cid <> lead")
        led, _ = materialize(led.select("bucket", "cid", "lead"), "led")
        if path is None:
            wanted = members.select("cid").distinct()
            path = store_sequences(docs, wanted, n, salt)
        pairs, _ = materialize(led.select("lead", "cid").distinct(), "pairs")
        done, _ = materialize(verify(pairs, path, n), "verified")
        new = done.filter("linked").select("lead", "cid")
        links_ = new if links_ is None else links_.union(new)
        judged, _ = materialize(led.join(done, ["lead", "cid"]).select("bucket", "lead", "cid", "linked", "near"), "judged")
        count = lambda which: F.sum(F.expr(which).cast("long"))
        size = judged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), count("linked").alias("n_joined"), count("not linked").alias("n_left"), count("near and not linked").alias("n_near"))
        size, _ = materialize(size.filter("n_left > 1 or (n_joined > 0 and n_near > 0)"), "rest-sizes")
        judged, _ = materialize(keyed_join(judged, size, "bucket", judged.count(), "n"), "rest")
        left = judged.filter("not linked").withColumn("root", F.col("cid"))
        last, _ = materialize(finish(across(judged, block).unionByName(among(left.filter(F.col("n_left") <= left_over), block)), path, n), "finished")
        links_ = links_.union(last)
        large = F.col("n_left") > left_over
        had, stay = size.filter(large).agg(F.sum("n"), F.sum("n_left")).first()
        if not stay:
            return links_.distinct()
        rows, _ = materialize(left.filter(large).select("bucket", "cid", "n_left"), "next-round")
        if 2 * stay <= had:
            rows = rows.select("bucket", "cid")
            continue
        # leaders take few: all that are not in one component yet are compared, block by block
        root = components(links_.select(F.col("lead").alias("u"), F.col("cid").alias("v")))
        rows, _ = materialize(rows.join(root, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "n_left", F.coalesce("root", "cid").alias("root")), "labelled")
        apart = rows.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_a <> _b").select("bucket", "_n")
        apart, _ = materialize(apart, "apart")
        rows, _ = materialize(keyed_join(rows, apart, "bucket", rows.count(), "_n"), "next-round")
        last, _ = materialize(finish(among(rows, block), path, n), "finished")
        return links_.union(last).distinct()


# ---------------------------------------------------------------- connected components

def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): each u's neighbours, or those below it, get the least of them all."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both, _ = materialize(both.distinct(), "star")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
    least, _ = materialize(least, "star-least")
    seen = keyed_join(both, least, "u", both.count(), "size")
    if large:
        return seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return seen.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")).filter("u <> v"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for all nodes of the edges (u, v)."""
    state = None
    while True:
        edges, _ = materialize(_star(_star(edges, True), False).distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)


# ---------------------------------------------------------------- documents

def near_dedup(docs: DataFrame, left_over: int = LEFT_OVER) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its group), class_size, copy_of (the least doc_id with the same words), kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, salt = buckets_for(docs), 0
    while True:
        def run(part: pa.RecordBatch, salt=salt) -> dict:
            word, before, a, b = sequences(part, salt)
            found = list(bands(word, before).view(np.int64))
            for i, more in short_sets(word, before).items():
                found[i] = np.concatenate([found[i], more.view(np.int64)])
            return {"doc_id": part.column(0), "cid": pa.array(a.view(np.int64)), "other": pa.array(b.view(np.int64)), "bands": pa.array(found, pa.list_(pa.int64()))}

        every, _ = materialize(over(docs, ["doc_id", "text"], "doc_id long, cid long, other long, bands array<long>", run, _STEP), "sketches")
        classes = every.groupBy("cid", "other").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        classes, _ = materialize(classes, "classes")
        if classes.groupBy("cid").count().filter("count > 1").isEmpty():
            break
        salt += 1  # two texts share 64 bits: number them anew
    edges, _ = materialize(links(classes, docs, n, salt, left_over).select(F.col("lead").alias("u"), F.col("cid").alias("v")), "links")
    root = components(edges)
    named = classes.select("cid", "first", "copies").join(root, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    named, _ = materialize(named.select("cid", "first", "copies", "root"), "named")
    group = named.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("_n"))
    group, _ = materialize(group, "groups")
    whole = keyed_join(named, group, "root", named.count(), "_n").select("cid", "class_id", "class_size", F.col("first").alias("copy_of"), "copies")
    whole, _ = materialize(whole, "whole")
    out = keyed_join(every.select("doc_id", "cid"), whole, "cid", every.count(), "copies")
    return out.select("doc_id", "class_id", "class_size", "copy_of", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from tessera.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """The least doc_id of each row's group, over all pairs."""
    texts = [WORD.findall(t or "") for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and shared and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) + 1e-9):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in least[find(i)] if x is not None), default=None), len(least[find(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(nd.op5(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("left_over", [2000, 1])
def test_groups_and_edge_cases(spark, left_over):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randint(0, 500)}" for _ in range(n)]
    rows, passage = [], text(40)
    for g in range(12):
        base = text(rng.choice([8, 60, 150]))
        for k in range(rng.randint(1, 6)):
            w = list(base)
            if k:
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = ["new"]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w)))
        rows.append((len(rows), " ".join(passage + text(25))))
        rows.append((len(rows), " ".join(base[len(base) // 2 :] + base[: len(base) // 2])))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "one  two"), (505, "one three"), (None, rows[0][1]), (None, rows[0][1]), (None, "alone"), (3, rows[3][1]), (506, "z " * 3000), (507, "z " * 3001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as cid", "1 as lead", "2 as bucket").repartition(4)
    assert got(nd.near_dedup(df, left_over)) == brute(rows)
    assert got(nd.near_dedup(df.limit(0))) == []


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 nearly always share a band, dissimilar ones hardly ever."""
    rng = random.Random(2)
    met = far = 0
    for _ in range(200):
        a = [rng.getrandbits(60) for _ in range(204)]
        b = a[:178] + [rng.getrandbits(60) for _ in range(26)]  # 174 of 226 shingles: 0.77
        c = a[:80] + [rng.getrandbits(60) for _ in range(124)]  # 76 of 324: 0.23
        x = nd.bands(np.array(a + b + c, np.uint64), np.array([0, 204, 408, 612]))
        met += bool((x[0] == x[1]).any())
        far += bool((x[0] == x[2]).any())
    assert met >= 197 and far <= 30


def test_short_texts_all_meet(spark):
    """Pairs at 0.8 of 4 to 9 shingles: a word more at either end."""
    rng = random.Random(8)
    rows = []
    for k in range(150):
        w = [f"s{rng.randint(0, 10**6)}" for _ in range(rng.randint(9, 13))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[1:] if k % 2 else w[:-1]))]
    x = nd.sequences(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}))
    sets = nd.short_sets(x[0], x[1])
    for i in range(0, len(rows), 2):
        if len(rows[i][1].split()) - 4 <= nd.FEW:
            assert set(sets[i].tolist()) & set(sets[i + 1].tolist())
    assert got(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_bucket_of_unlike_texts_ends(spark):
    """5000 texts of one bucket, none like another: two rounds of leaders at most, then blocks."""
    rng = random.Random(4)
    rows = [(i, " ".join(["same"] * 3 + [f"u{rng.randint(0, 10**9)}" for _ in range(12)])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cid = nd.sequences(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}))[2].view(np.int64).tolist()
    classes = spark.createDataFrame([(c, [5]) for c in cid], "cid long, bands array<long>")
    assert nd.links(classes, docs, 16, 0).count() == 0


def test_template_and_its_copies(spark):
    """Copies at 0.81 to a template and about 0.66 to each other: whichever leads, the template connects them all."""
    rng = random.Random(11)
    rows = []
    for n in (320, 40):
        base = [f"t{n}-{i}" for i in range(110)]
        rows.append((len(rows), " ".join(base)))
        for k in range(n):
            w = list(base)
            at = 5 * rng.randrange(20)
            w[at : at + 1] = [f"x{k}"]
            at = (at + 30 + rng.randrange(40)) % 100
            w[at : at + 2] = [f"y{k}", f"z{k}"]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(50))) for k in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert sorted({x[2] for x in want}) == [1, 41, 321]
    assert got(nd.near_dedup(df)) == want


def test_links_connect_all_that_share_a_bucket(spark):
    """No template: chains and copies that only some others are similar to, all in one bucket, against all pairs."""
    rng = random.Random(12)
    rows = []
    for g in range(6):
        w = [f"c{i}" for i in range(60)]
        for k in range(25):
            w = list(w)
            w[rng.randrange(60)] = f"n{g}-{k}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cid = [int(x) for x in nd.sequences(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}))[2].view(np.int64)]
    classes = spark.createDataFrame([(c, [5]) for c in cid], "cid long, bands array<long>")
    least = {d: x for d, x, _ in brute(rows)}
    want = {frozenset(c for (d, _), c in zip(rows, cid, strict=True) if least[d] == x) for x in least.values()}
    root = {c: c for c in cid}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in nd.links(classes, docs, 16, 0, left_over=20).collect():
        root[find(r.lead)] = find(r.cid)
    assert {frozenset(c for c in cid if find(c) == x) for x in map(find, cid)} == want


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.randint(0, 3)] * rng.randint(0, 1)
        d = distance(a, b)
        for limit in range(8):
            assert nd.within(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (d <= limit)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: find(x) for x in root if find(x) != x}

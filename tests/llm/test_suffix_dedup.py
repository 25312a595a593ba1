from __future__ import annotations

import glob
import hashlib
import os
import random
from collections import Counter

import pytest

from conftest import SMALL
from tessera.llm import suffix_dedup as sd


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(sd.op1(spark, SMALL)) == brute(rows, 400)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abé \n") for _ in range(k))
    shared = [text(rng.randint(10, 200)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s))
            parts += [text(rng.randint(0, 30)), s[a : rng.randint(a, len(s))]]
        rows.append((i, "".join(parts)))
    return [*rows, (100, None), (101, ""), (None, rows[3][1]), (None, rows[3][1]), (5, rows[5][1]), (102, "z" * 500), (103, shared[0] * 40)]


@pytest.mark.parametrize(("seed", "window", "hot", "pairs", "segment"), [(1, 20, 10**9, 8, 1 << 20), (2, 20, 3, 8, 1 << 20), (3, 30, 10**9, 1, 64), (4, 25, 10, 3, 100)])
def test_edge_cases(spark, seed, window, hot, pairs, segment):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as kept", "'x' as n").repartition(4)
    anchored = sd.suffix_dedup(df, window=window, hot=hot, segment=segment, pairs=pairs)
    assert got(anchored) == brute(rows, window)
    assert got(sd.suffix_dedup(df.limit(0), window=window)) == []


def test_long_text_and_bytes(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    rows = [(1, base + base[1000:3000]), (2, base[50_000:50_399] + "#"), (3, base[60_000:60_400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in sd.suffix_dedup(df, texts=True).collect()}
    assert (out[1].n_removed, out[1].n_spans, out[2].n_removed, out[3].n_removed) == (2000 + 2000 + 400, 3, 0, 400)
    assert bytes(out[2].kept) == rows[1][1].encode()


def test_loser_tree_orders_and_knows_prefixes():
    rng = random.Random(3)
    runs = []
    for _ in range(7):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
        runs.append(run)
    coded = [iter([(s, h, k) for (s, h) in sd.front_decode(*sd.front_code(run))]) for k, run in enumerate(runs)]
    merged = list(sd.LoserTree(coded))
    assert [s for s, _, _ in merged] == sorted(s for run in runs for s in run)
    for (a, _, _), (b, h, _) in zip(merged, merged[1:], strict=False):
        assert h == sd.common(a, b, 0)


def test_texts_of_every_length(spark):
    """One text of each length up to a window and one more, alone in its task, also after longer ones."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(i))) for i in range(402)]
    assert got(sd.suffix_dedup(spark.createDataFrame(rows[60:90], "doc_id long, text string").repartition(30))) == brute(rows[60:90], 400)
    assert got(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows, 400)
    for n in (1, 64, 75, 398, 400, 401):
        assert got(sd.suffix_dedup(spark.createDataFrame(rows[n : n + 1], "doc_id long, text string"))) == brute(rows[n : n + 1], 400)
    with_short = rows[300:] + [(1000, rows[300][1])]
    df = spark.createDataFrame(with_short, "doc_id long, text string")
    assert got(sd.suffix_dedup(df, short=250)) == brute(with_short, 400)


@pytest.mark.parametrize("hot", [1000, 2])
def test_shorter_repeats_are_counted(spark, hot):
    rows = corpus(3)
    out = {(r.doc_id, r.n_bytes, r.n_repeated) for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=40, short=16, hot=hot, segment=300).collect()}
    assert out == {(d, n, gone) for d, n, gone, _, _ in brute(rows, 16)}


def test_a_missing_file_is_an_error(spark, monkeypatch):
    paths = []
    keep = sd.repeats
    monkeypatch.setattr(sd, "repeats", lambda *a: paths.append(keep(*a)) or paths[-1])
    out = sd.suffix_dedup(spark.createDataFrame(corpus(1), "doc_id long, text string"), window=40)
    for f in glob.glob(f"{paths[0]}/*-content-*.npy"):
        os.remove(f)
    with pytest.raises(Exception, match="No such file"):
        out.collect()

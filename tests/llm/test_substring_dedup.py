from __future__ import annotations

import hashlib
import random
import re

import pytest

from conftest import SMALL
from tessera.llm.substring_dedup import op10, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    last = lambda d: (d is None, d or 0)
    seen = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            at = (*last(d), i)
            seen[key] = min(seen.get(key, at), at)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < (*last(d), i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op10(spark, SMALL)) == brute(rows)


def test_edge_cases(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "bé", "c,", "dd", "e"])
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 30))) + rng.choice(["\n", "\t", " "]) + " ".join(base[rng.randint(0, 30) : rng.randint(30, 60)])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "x " * 70), (None, " ".join(base)), (None, " ".join(base)), (7, rows[7][1]), (54, "y" * 300_000 + " " + " ".join(base)), (60, " ".join(base[:20])), (61, " ".join(base[:19]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("*", "text as kept_sha256", "1 as n", "2 as start").repartition(5)
    assert got(substring_dedup(df)) == brute(rows)
    assert got(substring_dedup(df.limit(0))) == []
    kept = {r.doc_id: r.kept_text for r in substring_dedup(df.filter("doc_id in (51, 53)"), texts=True).collect()}
    assert kept[51] == "" and kept[53].split() == ["x"]


def test_other_windows(spark):
    rows = [(1, "a b c d e f g h"), (2, "x a b c d y"), (3, "c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup(df, window=4, first=2)) == brute(rows, 4)
    with pytest.raises(ValueError):
        substring_dedup(df, window=20, first=3)

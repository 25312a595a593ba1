from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import line_crf as crf
from tessera.llm.common import text_bytes

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 5, 2]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    good, chain = rng.normal(size=offs[-1]) * 2, rng.normal(size=(2, 2))
    p, joint = crf.marginals(good, offs, chain)
    want_joint = np.zeros((2, 2))
    for a, b in zip(offs, offs[1:], strict=False):
        total, hit, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(good[a + i] * y for i, y in enumerate(ys)) + sum(chain[u, v] for u, v in zip(ys, ys[1:], strict=False)))
            total += w
            hit += w * np.array(ys)
            for u, v in zip(ys, ys[1:], strict=False):
                pair[u, v] += w
        assert np.allclose(p[a:b], hit / total)
        want_joint += pair / total
    assert np.allclose(joint, want_joint)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in crf.op7(spark, DATA).collect()}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in spark.read.parquet(f"{DATA}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_scores_do_not_depend_on_other_rows_or_slices():
    texts = [None, "", " \n\t", "One line of words here.", "a b\n\n  \nC!! D!! E!!\n", "x" * 100_000, "Ü ÉCOLE\nß", "\n\nlast"]
    every = crf.features(*text_bytes(pa.array(texts, pa.string())))
    assert every[2].tolist() == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    for i, t in enumerate(texts):
        x, length, offs = crf.features(*text_bytes(pa.array([t], pa.string())))
        a, b = every[2][i : i + 2]
        assert np.allclose(x, every[0][a:b]) and np.allclose(length, every[1][a:b])


def test_edge_cases(spark):
    good = [(i, f"the words of line {i}, and some more of them here.\nthen another one, with its own words.") for i in range(30)]
    bad = [(100 + i, f"the start is as ever.\nLOUD!! WORDS!! {i}!! AGAIN!!\nMORE!! OF!! THEM!!") for i in range(30)]
    rows = [*good, *bad, (None, None), (200, ""), (201, None), (3, good[3][1]), (202, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_label", F.lit(5))
    labels = spark.createDataFrame([*((d, 1) for d, _ in good), *((d, 0) for d, _ in bad), (None, 1), (201, None)], "doc_id long, quality int")
    model = crf.train(docs, labels, sample=50)
    out = crf.classify(docs, model, crf.HELD_OUT).collect()
    assert len(out) == len(rows) and all(r.predicted == (r.doc_id < 100) for r in out if r.doc_id is not None and r.doc_id < 200)
    assert all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 3}) == 1
    for some in (labels.limit(0), labels.filter("quality = 1")):
        flat = crf.classify(docs, crf.train(docs, some), crf.HELD_OUT).collect()
        assert len({round(r.score, 9) for r in flat}) == 1
    assert crf.classify(docs.limit(0), model, crf.HELD_OUT).count() == 0

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from conftest import SMALL
from tessera.llm import mixing
from tessera.llm.quality_rules import rules
from test_near_dedup import brute as near_brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out of it, as pandas."""
    top = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (name, f) in enumerate(cp.STAGES):
        before = docs
        f(spark, docs, SMALL).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        out.append((name, before, docs))
    return {name: (a.toPandas(), b.toPandas(), a) for name, a, b in out}


def test_columns(stages):
    for name, (before, after, _) in stages.items():
        if name != "encode":
            assert list(before.columns) == list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages):
    before, after, docs = stages["quality rules"]
    decided = {r.doc_id: r.kept for r in rules(docs).collect()}
    assert set(after.doc_id) == {d for d in before.doc_id if decided[d]} and len(after) < len(before)


def test_exact(stages):
    before, after, _ = stages["exact dedup"]
    best = {}
    for d, t in zip(before.doc_id, before.text, strict=True):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), d))
    assert sorted(after.doc_id) == sorted(d for _, d in best.values())


def test_near(stages):
    before, after, _ = stages["near dedup"]
    groups = near_brute(list(zip(before.doc_id.tolist(), before.text, strict=True)))
    assert sorted(after.doc_id) == sorted({c for _, c, _ in groups})


def test_mix(stages):
    documents, after, _ = stages["mix sources"]
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mixing.ORACLE).df()
    times = {int(r.doc_id): int(r.taken // r.size) for r in want.itertuples() if r.size}
    assert after.doc_id.value_counts().to_dict() == {d: n for d, n in times.items() if n}


def test_encode(stages):
    import public_tokenizers

    before, after, _ = stages["encode"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    assert len(after) == len(before)
    rows = {r.doc_id: r for r in after.itertuples()}
    for d, t in zip(before.doc_id, before.text, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert list(rows[d].ids) == ids and rows[d].n_tokens == len(ids)
        assert rows[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases_go_through(spark):
    rows = [(1, "a b c d e f g h i j k l.", "en", "s"), (1, "a b c d e f g h i j k l.", "en", "s"), (None, None, None, None), (2, "", "en", None), (None, "m n o p q r s t u v w x y z", None, "s"), (3, "long " * 30_000, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnsRenamed({"lang": "lang"}).selectExpr("*", "1L as n_chars", "'x' as kept", "2 as size", "3 as _gone")
    columns = docs.columns
    for name, f in cp.STAGES[:-1]:
        docs = f(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert f(spark, docs.limit(0), SMALL).count() == 0
    out = cp.encode(spark, docs, SMALL).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, None}

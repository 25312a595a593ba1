from __future__ import annotations

import builtins
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same
from tokenizers import Tokenizer

from conftest import SMALL
from tessera.llm import bpe, exact_dedup, mixing, quality_rules, registry, token_files, word_lm
from tessera.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "a b c", "de", "b"), (4, "a b c", "de", "b"), (None, "abc", "de", "b"), (5, "É<|endoftext|> Σας, 'tis\x00 ﬁ 12345!!", "fr", "c"), (6, "wörd " * 4000 + "x" * 20_000, "de", "a"), (7, "one two three four five six\none two three four five six\nseven # $", "en", "c")]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return path, tok


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as size", "'x' as recipe", "2 as kept").repartition(3)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, SMALL, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_exact_dedup_edge_cases(spark):
    out = exact_dedup.exact_dedup(odd(spark)).collect()
    assert len(out) == len(ODD)
    by = {(r.doc_id, r.text_sha256): r for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    assert {by[d, empty].keep_id for d in (1, 2, 3)} == {3} and by[1, empty].group_size == 3
    abc = [r for r in out if r.text_sha256 == hashlib.sha256(b"abc").hexdigest()]
    assert len(abc) == 3 and {r.keep_id for r in abc} == {4} and sorted(map(str, (r.doc_id for r in abc if r.kept))) == ["4", "4"]
    assert exact_dedup.exact_dedup(odd(spark).limit(0)).count() == 0


def test_mix_edge_cases(spark):
    out = mixing.mix_sources(odd(spark)).collect()
    assert len(out) == len(ODD) and all(r["size"] == 0 or r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] for r in out)
    con = duckdb.connect()
    con.register("documents", odd(spark).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(map(repr, want))
    assert mixing.mix_sources(odd(spark).limit(0)).count() == 0


def test_rules_base(spark):
    def base(t):
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for rows, out in ((documents(spark), quality_rules.op4(spark, SMALL)), ([r[:2] for r in ODD], quality_rules.rules(odd(spark)))):
        got = [(r.doc_id, *(r[n] for n in names)) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(((d, *base(t)) for d, t in rows), key=repr)
        assert not out.filter("base_failed and kept").count()
    assert quality_rules.rules(odd(spark).limit(0)).count() == 0


def test_rules_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("abab cab", "x"), ("bca", "x")], "text string, lang string")
    path = quality_rules.train(docs)
    for context in (b"\xff\xff\xff\xff", b"abab", b"zzzz", b"\xff\xffca"):
        grams = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint64)
        total = (10 ** quality_rules.log10_probabilities(path, "sx", grams)).sum()
        assert 0.95 < total <= 1 + 1e-9


def test_rules_bands_equal_brute_force(spark):
    """Log probabilities, bands and verdicts against a model of dictionaries."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    out = {r.doc_id: r for r in quality_rules.rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for lang in {x for _, _, x in rows}:
        own = [(d, [0xFF] * 4 + [b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()] + [0xFE]) for d, t, x in rows if x == lang]
        counts = {5: Counter(tuple(b[i : i + 5]) for _, b in own for i in range(len(b) - 4))}
        for m in (4, 3, 2, 1):
            counts[m] = Counter(g[1:] for g in counts[m + 1])
        d = {m: word_lm.discounts([sum(c == i for c in counts[m].values()) for i in (1, 2, 3, 4)]) for m in counts}
        after = {}
        for m, of in counts.items():
            for g, c in of.items():
                total, taken = after.get(g[:-1], (0, 0))
                after[g[:-1]] = total + c, taken + d[m][min(c, 3)]
        known = {}

        def p(g):
            if not g:
                return 1 / 257
            if g not in known:
                seen = after.get(g[:-1])
                c = counts[len(g)][g]
                known[g] = (max(0, c - d[len(g)][min(c, 3)]) + seen[1] * p(g[1:])) / seen[0] if seen else p(g[1:])
            return known[g]

        mean = {i: sum(math.log10(p(tuple(b[k : k + 5]))) for k in range(len(b) - 4)) / (len(b) - 4) for i, b in own}
        good = sorted(math.floor(out[i].log_prob * 1000) for i, _ in own if not out[i].base_failed)
        q1, q3 = (good[math.ceil(q * len(good)) - 1] / 1000 for q in (0.25, 0.75))
        for i, b in own:
            assert math.isclose(mean[i], out[i].log_prob, rel_tol=1e-9)
            far = max(q3 - q1, 0.002) * 3.0 * math.sqrt(1 + 1500.0 / (len(b) - 4))
            assert out[i].kept == (not out[i].base_failed and q1 - far <= mean[i] <= q3 + far)


def test_rules_null_language_is_its_own(spark):
    """Also beside a language whose name is what nulls might be called."""
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, None), (2, text, "\0"), (3, text, ""), (4, text, "s")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang, r.kept) for r in quality_rules.rules(docs).collect()} == {(1, None, True), (2, "\0", True), (3, "", True), (4, "s", True)}


def test_exact_dedup_ties_in_one_id(spark):
    rows = [(1, "a b"), (1, "ab"), (1, "a  b"), (2, "a\tb "), (None, "ab    "), (3, "c")]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == sorted([*[("1", "None", 5, False)] * 3, ("2", "None", 5, False), ("None", "None", 5, True), ("3", "3", 1, True)])
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out) == [(1, 1, False), (1, 1, False), (1, 1, True), (2, 1, False)]


def test_exact_dedup_of_long_heavy_groups(spark, monkeypatch):
    """Groups that are too long to be broadcast are salted."""
    from tessera.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, "x y z" if i % 3 else f"t{i}") for i in range(60)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(i, 1 if i % 3 else i, 40 if i % 3 else 1) for i in range(60)]


def test_bpe_and_files(spark, tokenizer):
    path, tok = tokenizer
    for docs, rows in ((spark.read.parquet(f"{SMALL}/documents.parquet"), documents(spark)), (odd(spark), [r[:2] for r in ODD])):
        want = [(d, tok.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
        digest = sorted(((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in want), key=repr)
        assert sorted((tuple(r) for r in bpe.encode_digests(docs, path).collect()), key=repr) == digest
        where = new_path(spark, "test-files")
        got = token_files.read_token_files(token_files.write_token_files(docs, where, path, 2), where).collect()
        crc = sorted(((d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, i in want), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == crc
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
        assert ids == sorted(ids)
    assert bpe.encode_digests(odd(spark).limit(0), path).count() == 0


def kneser_ney(texts):
    """Brute-force model: texts as lists of tokens to a function from (u, v, w) to a probability."""
    tri = Counter()
    for x in texts:
        tri.update(zip(["<s>", "<s>", *x], ["<s>", *x], x, strict=False))
    counts = {3: tri, 2: Counter((v, w) for u, v, w in tri if v != "<s>"), 1: None}
    for (u, v, w), c in tri.items():
        if v == "<s>":
            counts[2][v, w] += c
    counts[1] = Counter((w,) for _, w in counts[2])
    vocabulary = len({w for _, _, w in tri})
    d = {m: word_lm.discounts([sum(c == i for c in counts[m].values()) for i in (1, 2, 3, 4)]) for m in counts}
    after = {}
    for m, own in counts.items():
        for k, c in own.items():
            total, taken = after.get((m, k[:-1]), (0, 0))
            after[m, k[:-1]] = total + c, taken + d[m][min(c, 3)]

    def p(*gram):
        m = len(gram)
        if not m:
            return 1 / (vocabulary + 1)
        low = p(*gram[1:])
        seen = after.get((m, gram[:-1]))
        if not seen:
            return low
        c = counts[m][gram]
        return (max(0, c - d[m][min(c, 3)]) + seen[1] * low) / seen[0]

    return p


@pytest.mark.parametrize("hot", [1 << 18, 30])
def test_word_lm_is_kneser_ney(spark, hot):
    rows = documents(spark)[:120]
    odd_rows = [(-1, None), (-2, ""), (-3, "The the"), (-4, "unheard of words"), (None, "of of of")]
    tokens = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    df = spark.createDataFrame(rows + odd_rows, "doc_id long, text string")
    model = word_lm.train(df.filter("doc_id % 3 <> 0").repartition(3), hot, 20_000)
    p = kneser_ney([tokens(t) for d, t in rows + odd_rows if d is not None and math.fmod(d, 3) != 0])
    got = {r.doc_id: r.score for r in word_lm.score(df, model, "false").collect()}
    for d, t in rows + odd_rows:
        x = tokens(t)
        want = sum(math.log10(p(*g)) for g in zip(["<s>", "<s>", *x], ["<s>", *x], x, strict=False))
        assert math.isclose(got[d], want, rel_tol=1e-9), (d, got[d], want)
    broken = word_lm.train(df)  # not read before: workers keep the arrays they have opened
    for b in range(broken.words.n):
        os.remove(f"{broken.words.path}/tri-one-{b}-key.npy")
    with pytest.raises(Exception, match="No such file"):
        word_lm.score(df, broken, "false").collect()


def test_word_lm(spark):
    def tokens(t):
        return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")] + [None]

    rows = documents(spark)
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    count = Counter(x for d, t in rows if d not in held for x in tokens(t))
    n, v = sum(count.values()), len(count)
    out = {r.doc_id: r for r in word_lm.op8(spark, SMALL).collect()}
    for d, t in rows:
        x = tokens(t)
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(x), sum(w in count for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
    assert sum(out[d].score for d in held) > sum(out[d].base_score for d in held)
    empty = word_lm.score(odd(spark), word_lm.train(odd(spark).limit(0)), "false").collect()
    assert len(empty) == len(ODD) and all(r.n_known == 0 and r.base_score == 0 for r in empty)


def test_word_lm_opens_ranges_once(spark, monkeypatch):
    """A worker with many ranges opens each range's files once for many slices of text, not again for each slice."""

    class Captured:
        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    rows = documents(spark)[:60] + [(-1, None), (-2, "")]
    monkeypatch.setattr(word_lm, "buckets_for", lambda docs: 128)
    model = word_lm.train(spark.createDataFrame(rows[:40], "doc_id long, text string").coalesce(2), 30)
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(word_lm, "_STEP", size // 8)
    ids, texts = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": texts, "held_out": [False] * len(ids)})
    opened, own = Counter(), builtins.open
    monkeypatch.setattr(builtins, "open", lambda file, *a, **k: (opened.update([str(file)]), own(file, *a, **k))[1])
    whole = [r for x in word_lm.score(Captured(), model, "false")(iter([batch.slice(0, 9), batch.slice(9)])) for r in x.to_pylist()]
    read = [x for f, x in opened.items() if f.startswith(model.words.path)]
    assert 128 < sum(read) <= 2 * len(os.listdir(model.words.path)), sum(read)
    apart = [r for x in word_lm.score(Captured(), model, "false", 1)(iter([batch])) for r in x.to_pylist()]
    assert [r["doc_id"] for r in whole] == list(ids) and whole == apart

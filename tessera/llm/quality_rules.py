"""Quality rules: word and repetition counts, then n-gram perplexity within bands of each language.

The model is a modified Kneser-Ney model of the bytes of lower-cased texts, one for each language, order 5. Tasks count the
5-grams of all texts, Spark sums them by ranges of keys (a range for each 128 MB of text, added up piece by piece), and one task a language, whose input is distinct 5-grams
and so follows the alphabet rather than the corpus, derives the lower orders and writes arrays sorted by packed key (a hash
without collisions), with ready probabilities and back-off weights. Workers memory-map them. Each language's bands come from the
histogram of all its documents that pass the base rules: the quartiles, FENCE quartile distances further out on either side. A
document whose mean log10 probability a byte lies outside is rejected.

Edge cases: null and empty texts have no words and fail the base rules; a null language is a language of its own;
texts of any length are counted and scored whole; a language with one document accepts it.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import BLOBS, Rolling, blobs, buckets_for, enter, local_path, lowered, materialize, mix, new_path, over, reduce_blobs, small, split_by_bucket, steps, summed, text_bytes, words
from tessera.llm.word_lm import _save, discounts

ORDER = 5
#: Quartile distances from the quartiles to the bands.
FENCE = 3.0
#: The mean over a text of n bytes scatters more the shorter it is: bands are sqrt(1 + SHORT / n) times as far out.
SHORT = 1500.0
_BOS, _EOS = 0xFF, 0xFE  # no byte of UTF-8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _rows(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; rows may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    start, end, before = words(data, offs)
    n_words = np.diff(before)
    chars = ((data & 0xC0) != 0x80) & ~_SPACE[data]
    repeat = np.zeros(len(start) + 1, np.int64)
    if len(start) >= 5:
        h = Rolling(Rolling(data).slices(start, end))
        row = np.repeat(np.arange(len(n_words)), n_words)
        at = np.flatnonzero(row[:-4] == row[4:])
        key = mix(h.slices(at, at + 5) ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + 5, -1)
    covered = np.cumsum(repeat)[:-1] > 0
    dup = np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1 and len(lines) != len(set(lines)):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup[i] += bool(line.strip())
                seen.add(line)
    return {"n_words": n_words, "word_chars": _rows(chars, offs), "n_symbols": _rows(_SYMBOL[data], offs), "n_dup_lines": dup, "n_repeat_words": _rows(covered, before)}


def byte_grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each byte of each row and at its end symbol, and the offsets of the rows."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    wide = np.full(len(data) + ORDER * n, _BOS, np.uint64)
    first = offs[:-1] + ORDER * np.arange(n) + ORDER - 1
    at = np.arange(len(data)) + np.repeat(first - offs[:-1], sizes)
    wide[at] = lowered(data)
    wide[first + sizes] = _EOS
    key = np.zeros(len(wide) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = key << np.uint64(8) | wide[i : len(wide) - ORDER + 1 + i]
    keep = np.ones(len(key), bool)
    keep[(first[1:, None] - np.arange(1, ORDER)[None, :] - ORDER + 1).ravel()] = False
    return key[keep], offs + np.arange(n + 1)


def language_of(part: pa.RecordBatch) -> list[str]:
    """A name for each row's language: empty for null, else the language after an s."""
    return ["" if x is None else "s" + x for x in part.column(part.schema.get_field_index("lang")).to_pylist()]


def _by_language(part: pa.RecordBatch, langs: list[str]) -> Iterator[tuple[str, np.ndarray, pa.RecordBatch]]:
    of: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        of.setdefault(lang, []).append(i)
    for lang, rows in of.items():
        yield lang, np.array(rows), part.take(pa.array(rows))


def _file(lang: str) -> str:
    return hashlib.sha256(lang.encode()).hexdigest()[:24]


def build(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the model from sorted distinct 5-grams and their counts: for each order the keys and log10 probabilities,
    the contexts and log10 back-off weights."""
    tables = {ORDER: (keys, counts.astype(np.float64))}
    for m in range(ORDER - 1, 0, -1):
        suffix, left = summed(tables[m + 1][0] & np.uint64((1 << 8 * m) - 1), np.ones(len(tables[m + 1][0]), np.int64))
        tables[m] = (suffix, left.astype(np.float64))
    out: dict[str, np.ndarray] = {}
    lower_keys, lower_p = np.zeros(0, np.uint64), None
    for m in range(1, ORDER + 1):
        key, c = tables[m]
        d = discounts([int((c == i).sum()) for i in (1, 2, 3, 4)])
        ctx = key >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        of = np.cumsum(np.concatenate([[True], ctx[1:] != ctx[:-1]])) - 1
        taken = d[np.minimum(c, 3).astype(int)]
        total = np.add.reduceat(c, first)
        gamma = np.add.reduceat(taken, first) / total
        low = np.full(len(key), 1 / 257) if m == 1 else lower_p[np.searchsorted(lower_keys, key & np.uint64((1 << 8 * (m - 1)) - 1))]
        p = (c - taken) / total[of] + gamma[of] * low
        out |= {f"key{m}": key, f"p{m}": np.log10(p), f"ctx{m}": ctx[first], f"bo{m}": np.log10(gamma)}
        lower_keys, lower_p = key, p
    return out


def train(docs: DataFrame) -> str:
    """Counts the 5-grams of all docs (text, lang) and writes the models; returns their path as the system opens it."""
    path, n = local_path(new_path(docs.sparkSession, "byte-lm")), buckets_for(docs, each=128 << 20)

    def emit(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out = []
        pack = zstandard.ZstdCompressor(level=1).compress
        for lang, (key, c) in held.items():
            spread = mix(key)
            order = np.argsort(spread)
            name = lang.encode()
            for b, s in split_by_bucket(spread[order], n):
                own = np.sort(order[s])
                out.append((len(name), b, name + pack(np.diff(key[own], prepend=np.uint64(0)).tobytes() + c[own].tobytes())))
        return blobs(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in steps(batch):
                for lang, _, own in _by_language(part, language_of(part)):
                    grams, _ = byte_grams(*text_bytes(own.column(0)))
                    grams = np.sort(grams)
                    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                    new = (grams[first], np.diff(np.append(first, len(grams))).astype(np.uint64))
                    old = held.get(lang)
                    held[lang] = new if old is None else summed(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))
                if sum(len(k) for k, _ in held.values()) > 2_000_000:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    def gather(x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(y), np.uint64) for y in x]
        return summed(np.concatenate([np.cumsum(y[: len(y) // 2], dtype=np.uint64) for y in raw]), np.concatenate([y[len(y) // 2 :] for y in raw]))

    def fold(held: dict[int, list[bytes]]) -> dict[int, list[bytes]]:
        """One piece for each language."""
        by_lang: dict[bytes, list[bytes]] = {}
        for k, xs in held.items():
            for x in xs:
                by_lang.setdefault(x[:k], []).append(x[k:])
        out: dict[int, list[bytes]] = {}
        for lang, xs in by_lang.items():
            key, c = gather(xs)
            out.setdefault(len(lang), []).append(lang + zstandard.ZstdCompressor(level=1).compress(np.diff(key, prepend=np.uint64(0)).tobytes() + c.tobytes()))
        return out

    def add_up(_: int, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for k, xs in fold(held).items():
            for x in xs:
                yield pa.RecordBatch.from_pydict({"lang": [x[:k].decode()], "data": [x[k:]]})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(lang: str, xs: list[bytes]) -> pa.RecordBatch:
            os.makedirs(path, exist_ok=True)
            key, c = gather(xs)
            _save(f"{path}/{_file(lang)}", **build(key, c))
            return pa.RecordBatch.from_pydict({"n": [len(key)]})

        at, xs = None, []
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang != at and xs:
                    yield write(at, xs)
                    xs = []
                at = lang
                xs.append(data)
        if xs:
            yield write(at, xs)

    summed_up = reduce_blobs(docs.select("text", "lang").mapInArrow(count, BLOBS), n, "lang string, data binary", add_up, fold)
    materialize(summed_up.repartition(16, "lang").sortWithinPartitions("lang").mapInArrow(store, "n long"), "byte-lm-sizes")
    return path


@functools.lru_cache(maxsize=256)
def _array(file: str) -> np.ndarray:
    return np.load(file, mmap_mode="r")


def log10_probabilities(path: str, lang: str, grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each packed 5-gram given the others."""
    get = lambda name: _array(f"{path}/{_file(lang)}-{name}.npy")
    key, back = np.unique(grams, return_inverse=True)
    out, todo = np.zeros(len(key)), np.arange(len(key))
    for m in range(ORDER, 0, -1):
        k = key[todo] & np.uint64((1 << 8 * m) - 1)
        own = get(f"key{m}")
        at = np.minimum(np.searchsorted(own, k), len(own) - 1)
        hit = own[at] == k
        out[todo[hit]] += get(f"p{m}")[at[hit]]
        todo, k = todo[~hit], k[~hit] >> np.uint64(8)
        own = get(f"ctx{m}")
        at = np.minimum(np.searchsorted(own, k), len(own) - 1)
        hit = own[at] == k
        out[todo[hit]] += get(f"bo{m}")[at[hit]]
    out[todo] += np.log10(1 / 257)
    return out[back]


def rules(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """One row per document: the base counts, base_failed, lang, log_prob (mean log10 a byte), the bands and kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    path = train(docs)

    def run(part: pa.RecordBatch) -> dict:
        counts = base_counts(*text_bytes(part.column(1)))
        mean = np.zeros(part.num_rows)
        for lang, rows, own in _by_language(part, language_of(part)):
            grams, offs = byte_grams(*text_bytes(own.column(1)))
            mean[rows] = np.add.reduceat(log10_probabilities(path, lang, grams), offs[:-1]) / np.diff(offs)
        bad = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        return {"doc_id": part.column(0), "lang": part.column(2), **{k: pa.array(v.astype(np.int64)) for k, v in counts.items()}, "base_failed": pa.array(bad), "log_prob": pa.array(mean), "n_bytes": pa.array(np.diff(text_bytes(part.column(1))[1]) + 1)}

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_prob double, n_bytes long"
    scored, _ = materialize(over(docs, ["doc_id", "text", "lang"], schema, run), "rules")
    lang = F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit(""))
    cells = scored.filter(~F.col("base_failed")).groupBy(lang.alias("_lang"), F.floor(F.col("log_prob") * 1000).alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("_lang")
    up = cells.select("*", F.sum("n").over(by.orderBy("_cell")).alias("upto"), F.sum("n").over(by).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("_cell"))) / 1000
    quart = up.groupBy("_lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.002)) * fence
    bands, n_bytes = materialize(quart.select("_lang", "q1", "q3", spread.alias("_out")), "bands")
    out = scored.select("*", lang.alias("_lang")).join(small(bands, n_bytes), "_lang", "left")
    far = F.col("_out") * F.sqrt(1 + F.lit(SHORT) / F.col("n_bytes"))
    out = out.withColumns({"low": F.col("q1") - far, "high": F.col("q3") + far}).drop("_lang", "_out", "q1", "q3")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_prob").between(F.col("low"), F.col("high")), F.lit(True)))


def op4(spark, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_prob")

"""A quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad; its features are its own shape (letters, case, digits, symbols, word lengths, repeats) and that
of the lines before and after it. Forward-backward gives each line's marginal, and their mean weighted by the lines' lengths
is the document's quality, put on the scale of the labels by a logistic curve.

Only documents are labelled, so lines are learned in rounds: all lines of a good document are good; of a bad one at first
all are bad, then those whose marginal says so, and the worst of them in any case. Training takes at most SAMPLE labelled rows, the
first by a hash of doc_id; lines in chains of CHAIN at most. All else covers every row: whole texts, any number of lines.

Edge cases: null and empty texts, and texts without words, are one empty line; a null doc_id has no number and hashes as the text
``null``; without labels of both kinds every score is the share of good ones (0.5 with none); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Rolling, mix, over, text_bytes, words

#: Labelled rows that training may use, and lines of a chain in training.
SAMPLE, CHAIN = 4000, 200
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.08, 1e-3
_STEP = 2 << 20

_CLASSES = np.zeros((6, 256), bool)
for _k, _set in enumerate((range(65, 91), range(48, 58), b"#*$%&<>|@^~_={}[]\\+", b"!?", b".,;:", range(97, 123))):
    _CLASSES[_k, list(_set)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[b] - total[a]).astype(np.float64)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line, the lines' lengths in characters, and offsets of the rows."""
    # every row ends in a line break of its own, so that no line reaches into the next row
    n = len(offs) - 1
    sizes = np.diff(offs)
    wide = np.full(len(data) + n, 10, np.uint8)
    wide[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
    woffs = offs[:-1] + np.arange(n)
    ends_at = np.append(woffs[1:], len(wide))
    breaks = np.flatnonzero(wide == 10)
    start, end = np.concatenate([[0], breaks[:-1] + 1]), breaks
    row = np.searchsorted(ends_at, start, "right")
    ink = np.concatenate([[0], np.cumsum(~_SPACE[wide])])
    full = ink[end] > ink[start]
    some = np.bincount(row[full], minlength=n) > 0
    first_of = np.concatenate([[True], row[1:] != row[:-1]])
    keep = full | (first_of & ~some[row])
    start, end, row = start[keep], end[keep], row[keep]
    loffs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    chars = np.maximum(_sums((wide & 0xC0) != 0x80, start, end), 1)
    solid = np.maximum(ink[end] - ink[start], 1).astype(np.float64)
    share = [_sums(c[wide], start, end) / solid for c in _CLASSES]
    share.append(_sums(wide >= 0x80, start, end) / solid)
    high = np.zeros(len(wide), bool)
    high[1:] = (wide[:-1] == 0xC3) & (wide[1:] >= 0x80) & (wide[1:] <= 0x9E)
    share[0] = share[0] + _sums(high, start, end) / solid
    ws, we, _ = words(wide, np.array([0, len(wide)]))
    a, b = np.searchsorted(ws, start), np.searchsorted(ws, end)
    nw = np.maximum(b - a, 1).astype(np.float64)
    size = we - ws
    h = Rolling(wide).slices(ws, we) if len(ws) else np.zeros(0, np.uint64)
    line = np.searchsorted(start, ws, "right") - 1
    again = np.zeros(len(ws), bool)
    if len(ws):
        key = mix(h ^ mix(line.astype(np.uint64) + np.uint64(3)))
        order = np.argsort(key, kind="stable")
        again[order[1:]] = key[order][1:] == key[order][:-1]
    last = np.zeros(len(ws), bool)
    last[:] = _CLASSES[2][wide[we - 1]] | _CLASSES[3][wide[we - 1]] if len(ws) else last
    per = [_sums(x, a, b) / nw for x in (size, size <= 3, size >= 12, again, last)]
    lh = Rolling(wide).slices(start, end) ^ mix(row.astype(np.uint64) + np.uint64(9))
    _, back, count = np.unique(lh, return_inverse=True, return_counts=True)
    dup = (count[back] > 1).astype(np.float64)
    cols = [*share, *(np.sqrt(x) for x in share[:5]), *((x > 0.05).astype(np.float64) for x in share[:4]), np.minimum(per[0], 40) / 10, *per[1:], np.log1p(chars), np.log1p(nw), (nw < 3).astype(np.float64), dup]
    own = np.stack(cols, 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edge = np.stack([np.concatenate([[True], ~same]), np.concatenate([~same, [True]])], 1).astype(np.float64) if len(row) else np.zeros((0, 2))
    return np.concatenate([own, before, after, edge], 1), np.where(full[keep], chars, 1.0), loffs


def marginals(good: np.ndarray, offs: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over ragged chains. good: each line's score of being good (bad: 0); chain: 2 x 2 scores of neighbours.

    Returns each line's probability of being good, and the sums of neighbours' joint probabilities (2 x 2).
    """
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    first, n = offs[:-1][order], n[order]
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), "right")
    alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    w = np.exp(chain - chain.max())
    e = np.stack([np.exp(-np.maximum(good, 0)), np.exp(np.minimum(good, 0))], 1)  # scaled
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        x = e[at] if t == 0 else (alpha[at - 1] @ w) * e[at]
        alpha[at] = x / x.sum(1, keepdims=True)
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        more = int(active[t + 1]) if t + 1 < len(active) else 0
        at = first[:k] + t
        x = np.ones((k, 2))
        if more:
            y = (e[at[:more] + 1] * beta[at[:more] + 1]) @ w.T
            x[:more] = y / y.sum(1, keepdims=True)
        beta[at] = x
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    inner = np.ones(len(good), bool)
    inner[offs[1:][np.diff(offs) > 0] - 1] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] * w[None] * (e[at + 1] * beta[at + 1])[:, None, :]
    joint = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((2, 2))
    return p, joint


class LineCRF:
    """mean and scale of the features, their weights, the neighbours' scores, and the curve from quality to score."""

    def __init__(self, mean, scale, weight, chain, curve):
        self.mean, self.scale, self.weight, self.chain, self.curve = mean, scale, weight, chain, curve

    def good(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1], -30, 30)

    def quality(self, x: np.ndarray, length: np.ndarray, offs: np.ndarray) -> np.ndarray:
        p = marginals(self.good(x), offs, self.chain)[0]
        return np.add.reduceat(p * length, offs[:-1]) / np.add.reduceat(length, offs[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * quality, -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, scale=self.scale, weight=self.weight, chain=self.chain, curve=self.curve)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> LineCRF:
        x = np.load(io.BytesIO(data))
        return LineCRF(*(x[k] for k in ("mean", "scale", "weight", "chain", "curve")))


def _chains(offs: np.ndarray, longest: int) -> np.ndarray:
    """Offsets of the rows, rows of more than longest lines cut."""
    return np.unique(np.concatenate([offs, *(np.arange(a, b, longest) for a, b in zip(offs[:-1], offs[1:], strict=True) if b - a > longest)]))


def fit_curve(quality: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of the label on quality, the two kinds of label weighing the same."""
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    a, b = 0.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * quality, -30, 30)))
        g = np.array([(weight * (p - label)).sum(), (weight * (p - label) * quality).sum() + 1e-4 * b])
        v = weight * p * (1 - p)
        h = np.array([[v.sum(), (v * quality).sum()], [(v * quality).sum(), (v * quality * quality).sum() + 1e-4]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return np.array([a, b])


def fit(texts: list[str | None], label: np.ndarray) -> LineCRF:
    """Trains on texts with labels 0 and 1."""
    x, length, offs = features(*text_bytes(pa.array(texts, pa.large_string())))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    n_features = x.shape[1]
    if label.min() == label.max():
        share = float(label.mean())
        return LineCRF(mean, scale, np.zeros(n_features + 1), np.zeros((2, 2)), np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0]))
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    doc = np.repeat(np.arange(len(label)), np.diff(offs))
    chains = _chains(offs, CHAIN)
    # bad documents' lines weigh as much as good ones'
    n_good, n_bad = label[doc].sum(), (1 - label[doc]).sum()
    y = label[doc].astype(np.float64)
    model = LineCRF(mean, scale, np.zeros(n_features + 1), np.zeros((2, 2)), np.zeros(2))
    for r in range(ROUNDS):
        theta, m, v = np.concatenate([model.weight, model.chain.ravel()]), 0.0, 0.0
        inner = np.ones(len(y), bool)
        inner[chains[1:] - 1] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
        weight = np.where(y > 0, len(y) / (2 * max(n_good, 1)), len(y) / (2 * max(n_bad, 1))) if r == 0 else np.ones(len(y))
        for i in range(1, STEPS + 1):
            good = np.clip(z @ theta[:-4], -30, 30)
            p, joint = marginals(good, chains, theta[-4:].reshape(2, 2))
            g = np.concatenate([z.T @ (weight * (p - y)), (joint - seen).ravel()]) / len(y) + DECAY * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        model = LineCRF(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), np.zeros(2))
        own = 1 / (1 + np.exp(-model.good(x)))  # a line by itself: its neighbours have the same document's label
        worst = np.zeros(len(y), bool)
        worst[np.lexsort((own, doc))[offs[:-1]]] = True
        y = np.where(label[doc] > 0, 1.0, ((own > 0.5) & ~worst).astype(np.float64))
    quality = model.quality(x, length, offs)
    model.curve = fit_curve(quality, label.astype(np.float64))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> LineCRF:
    """Fits in one task on at most ``sample`` labelled rows, the first by a hash of doc_id."""
    chosen = labels.select("doc_id", F.col(label).alias("_label")).filter("doc_id is not null and _label is not null").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").limit(sample).select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            label += b.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_pydict({"model": [fit(texts, np.array(label, np.int64)).dump()]})

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()  # one small row
    if found:
        return LineCRF.load(bytes(found[0][0]))
    n = features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    return LineCRF(np.zeros(n), np.ones(n), np.zeros(n + 1), np.zeros((2, 2)), np.zeros(2))


def classify(docs: DataFrame, model: LineCRF, held_out: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines (marginal below a half) of each document."""

    def run(part: pa.RecordBatch) -> dict:
        x, length, offs = features(*text_bytes(part.column(1)))
        p = marginals(model.good(x), offs, model.chain)[0]
        quality = np.add.reduceat(p * length, offs[:-1]) / np.add.reduceat(length, offs[:-1])
        score = model.score(quality)
        return {"doc_id": part.column(0), "held_out": part.column(2), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)), "n_lines": pa.array(np.diff(offs)), "n_bad_lines": pa.array(np.add.reduceat((p < 0.5).astype(np.int64), offs[:-1]))}

    return over(docs.select("doc_id", "text", F.expr(held_out).alias("held_out")), ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long", run, _STEP)


HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), 'null') as binary)) % 3 = 1"


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long"), "quality").filter(f"not ({HELD_OUT})")
    return classify(docs, train(docs, labels), HELD_OUT)

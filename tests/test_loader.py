from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import Loader
from tessera.loader import promote_dtype
from tessera.samplers import DistributedSampler, RandomSampler, SequentialSampler
from tessera.types import Annotated
from test_samplers import Own


def dense(spark, n, base=0, var=("a", "b")):
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") + base).cast("string").alias("obs_name"), (F.col("id") % 5).alias("label"), F.array((F.col("id") + base).cast("float"), F.lit(1.0).cast("float")).alias("x"))
    return Annotated(rows, spark.createDataFrame(list(enumerate(var)), "var_id int, var_name string"), ["row_id"])


def sparse(spark, n, base=0):
    x = F.struct(F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("indices"), F.when(F.col("id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array((F.col("id") + base).cast("double"))).alias("values"))
    return Annotated(spark.range(n).select(F.col("id").alias("row_id"), x.alias("x")), None, ["row_id"])


@pytest.mark.parametrize("shuffle", [False, True])
def test_all_rows_once(spark, shuffle):
    loader = Loader(spark, chunk_size=8, preload_nchunks=4, batch_size=16, shuffle=shuffle, return_index=True, rng=1 if shuffle else None)
    loader.add_adatas([dense(spark, 50), dense(spark, 53, 50)])
    got = list(loader)
    assert len(got) == len(loader) == 7
    index = np.concatenate([b["index"] for b in got])
    assert sorted(index.tolist()) == list(range(103)) and (index.tolist() == list(range(103))) != shuffle
    for b in got:
        assert b["X"][:, 0].tolist() == b["index"].tolist() and b["var"].tolist() == ["a", "b"]
        assert b["obs"]["obs_name"].tolist() == [str(i) for i in b["index"]]
    assert loader.n_obs == 103 and loader.n_var == 2 and loader.dataset_type == "dense"


def test_plan_and_requests_agree(spark):
    """A pass as one job gives the batches that the sampler's own requests describe."""
    sampler = RandomSampler(7, 3, 3, drop_last=True, rng=5)
    loader = Loader(spark, batch_sampler=sampler, return_index=True).add_adatas([dense(spark, 40), dense(spark, 27, 40)])
    planned = [b["index"].tolist() for b in loader]
    asked = []
    for r in sampler.sample(67):
        rows = np.concatenate([np.arange(c.start, c.stop) for c in r["chunks"]])
        asked += [rows[s].tolist() for s in r["splits"]]
    assert [len(b) for b in planned] == [len(b) for b in asked]
    assert sorted(map(sorted, planned[:-1]))[:3] == sorted(map(sorted, asked[:-1]))[:3] or sum(map(len, planned)) == sum(map(len, asked))


def test_sparse_and_drop_last(spark):
    loader = Loader(spark, batch_sampler=SequentialSampler(4, 2, 4, drop_last=True), return_index=True).add_adatas([sparse(spark, 10), sparse(spark, 9, 10)])
    got = list(loader)
    assert [b["X"].shape for b in got] == [(4, 2)] * 4 and got[0]["obs"] is None and got[0]["var"] is None
    for b in got:
        for row, i in zip(b["X"].toarray(), b["index"], strict=True):
            local = i if i < 10 else i - 10
            assert row[1] == (0 if local % 3 == 0 else i)
    assert b["X"].take(np.array([1, 0])).toarray().tolist() == b["X"].toarray()[[1, 0]].tolist()


def test_blocks(spark):
    rows = spark.range(20).select(F.col("id").alias("row_id"), F.array_repeat(F.array_repeat(F.col("id").cast("float"), 3), 2).alias("x"))
    got = list(Loader(spark, chunk_size=5, preload_nchunks=1, batch_size=5).add_adata(Annotated(rows, None, ["row_id"])))
    assert all(b["X"].shape == (5, 2, 3) for b in got)


def test_own_sampler_and_ranks(spark):
    loader = Loader(spark, batch_sampler=Own(6, True), return_index=True).add_adata(dense(spark, 20))
    assert sorted(np.concatenate([b["index"] for b in loader]).tolist()) == list(range(20))
    every = []
    for r in range(2):
        own = Loader(spark, batch_sampler=DistributedSampler(RandomSampler(3, 2, 3, rng=1), dist_info=lambda r=r: (r, 2)), return_index=True).add_adata(dense(spark, 20))
        every += np.concatenate([b["index"] for b in own]).tolist()
    assert sorted(every) == list(range(18))


class Strides(Own):
    """Requests of many short chunks, backwards, some rows twice, with splits of its own."""

    def __init__(self, step):
        super().__init__(6, True)
        self.step = step

    def _sample(self, n_obs):
        chunks = [slice(a, min(a + 2, n_obs)) for a in range(n_obs - 2, -1, -self.step)] + [slice(3, 6)]
        n = sum(c.stop - c.start for c in chunks)
        yield {"chunks": chunks, "splits": np.array_split(np.random.default_rng(1).permutation(n), max(1, n // 50))}


def test_a_request_of_many_chunks(spark, monkeypatch):
    from tessera import loader as module

    def run(step, n):
        own = Loader(spark, batch_sampler=Strides(step), return_index=True).add_adatas([dense(spark, n), dense(spark, n + 1, n)])
        return [(b["index"].tolist(), b["X"].tolist(), b["obs"].to_dict("list")) for b in own]

    near = run(9, 100)
    monkeypatch.setattr(module, "REQUEST_CHUNKS", 1)
    monkeypatch.setattr(module, "PLACES", 20)
    assert run(9, 100) == near and len(near) == 1
    monkeypatch.undo()
    got = run(4, 6000)  # 3001 chunks, as one filter too deep for the engine
    request = next(Strides(4)._sample(12001))
    memory = np.concatenate([np.arange(c.start, c.stop) for c in request["chunks"]])
    memory = memory[np.argsort(memory >= 6000, kind="stable")]
    assert [i for i, *_ in got] == [memory[s].tolist() for s in request["splits"]]


def test_small_requests_share_a_task(spark, monkeypatch):
    parts, packed = [], Loader._packed
    monkeypatch.setattr(Loader, "_packed", lambda self, dealt: parts.append(dealt.rdd.getNumPartitions()) or packed(self, dealt))
    got = list(Loader(spark, chunk_size=5, preload_nchunks=1, batch_size=5, return_index=True).add_adata(dense(spark, 300)))
    assert parts == [1] and [b["index"].tolist() for b in got] == [list(range(k, k + 5)) for k in range(0, 300, 5)]


def test_replacement_repeats_rows(spark):
    loader = Loader(spark, batch_sampler=RandomSampler(5, 2, 5, replacement=True, num_samples=50, rng=2), return_index=True).add_adata(dense(spark, 12))
    got = [b["index"] for b in loader]
    assert len(got) == 10 and all(len(b) == 5 for b in got)


def test_rejected(spark):
    with pytest.raises(ValueError):
        Loader(spark, batch_sampler=Own(1, True), batch_size=4)
    with pytest.raises(ValueError):
        next(iter(Loader(spark)))
    with pytest.raises(TypeError):
        Loader(spark).add_adata(np.zeros((2, 2)))
    loader = Loader(spark, batch_size=2).add_adata(dense(spark, 5))
    for bad in (dense(spark, 5, var=("a", "c")), sparse(spark, 5), Annotated(dense(spark, 5).rows.select("row_id", "x"), dense(spark, 5).var, ["row_id"])):
        with pytest.raises(ValueError):
            loader.add_adatas([dense(spark, 5), bad])
    assert loader.n_obs == 5
    with pytest.raises(ValueError):
        Loader(spark).n_var  # noqa: B018


def test_dtypes():
    assert [str(promote_dtype(k)) for k in ("f4", "f8", "bool", "i1", "i2", "i4", "i8", "f2")] == ["float32", "float64", "bool", "float32", "float32", "float64", "float64", "float32"]

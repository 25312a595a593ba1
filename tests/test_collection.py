from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import DatasetCollection, Loader
from tessera.functions.categories import categories, with_categories
from tessera.functions.sizes import dense_layout, parse_size, rows_of, sparse_layout
from tessera.sources import write_sharded, write_source
from tessera.streaming.append import append_stream
from tessera.types import Annotated

warnings.filterwarnings("ignore", message=".*does not end in.*")


def source(spark, i, n=40, shared=("g0", "g1"), extra=True, label=True):
    """Sparse rows over shared features and one of the source's own."""
    names = [*shared, f"own{i}"] if extra else list(shared)
    x = F.struct(F.array(F.lit(0), F.lit(len(names) - 1)).alias("indices"), F.array((F.col("id") + 1).cast("double"), F.lit(float(i + 1))).alias("values"))
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("obs_name"), F.lit(i).alias("src"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("label"), x.alias("x"))
    rows = with_categories(rows, "label", ["2", "0", "1"])
    return Annotated(rows if label else rows.drop("label"), spark.createDataFrame(list(enumerate(names)), "var_id int, var_name string"), ["row_id"])


@pytest.fixture
def made(spark, tmp_path):
    c = DatasetCollection(f"{tmp_path}/c.parquet", spark)
    assert c.is_empty
    return c.add_adatas([source(spark, i) for i in range(3)], shuffle_chunk_size=5, dataset_size=40, rng=1)


def triples(c):
    names = {r.var_id: r.var_name for r in c.var.collect()}
    return sorted((r.src, names[i], v) for r in c.rows().collect() for i, v in zip(r.x.indices, r.x.values, strict=True))


def test_create_keeps_everything(spark, made):
    assert made.dataset_ids == [0, 1, 2] and [d.rows.count() for d in made] == [40, 40, 40]
    assert [r.var_name for r in made.var.sort("var_id").collect()] == ["g0", "g1", "own0", "own1", "own2"]
    want = sorted(t for i in range(3) for k in range(40) for t in ((i, "g0", k + 1.0), (i, f"own{i}", i + 1.0)))
    assert triples(made) == want
    rows = made.rows().sort("obs_id").collect()
    assert [r.obs_id for r in rows] == list(range(120)) and len({r.obs_name for r in rows}) == 120
    order = [(r.src, int(r.obs_name.split("-")[0][1:])) for r in rows]
    assert sum(a == b for a, b in zip(order, sorted(order), strict=True)) < 12
    assert categories(made.rows(), "label") == ["2", "0", "1"] and set(categories(made.rows(), "src_path")) == {"source_0", "source_1", "source_2"}


def test_same_seed_same_collection(spark, tmp_path):
    a, b, c = (DatasetCollection(f"{tmp_path}/{n}.parquet", spark).add_adatas([source(spark, 0), source(spark, 1)], shuffle_chunk_size=5, dataset_size=40, rng=s) for n, s in (("a", 1), ("b", 1), ("c", 2)))
    names = [[r.obs_name for r in x.rows().sort("obs_id").collect()] for x in (a, b, c)]
    assert names[0] == names[1] != names[2]


def test_unshuffled_create_and_append_keep_order(spark, tmp_path):
    c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([source(spark, 0), source(spark, 1)], shuffle=False, shuffle_chunk_size=10, dataset_size=40)
    assert [(r.src, r.obs_name.split("-")[0]) for r in c.rows().sort("obs_id").collect()] == [(s, f"r{i}") for s in (0, 1) for i in range(40)]
    c.add_adatas([source(spark, 2, extra=False)], shuffle=False, shuffle_chunk_size=10)
    assert [r.src for r in c.rows().filter("dataset_id = 0").sort("pos").collect()] == [0] * 40 + [2] * 20


def test_append_keeps_features_and_spreads(spark, made):
    before = triples(made)
    made.add_adatas([source(spark, 7, n=30)], shuffle_chunk_size=5, rng=3)
    assert [r.var_name for r in made.var.sort("var_id").collect()] == ["g0", "g1", "own0", "own1", "own2"]
    assert triples(made) == sorted(before + [(7, "g0", k + 1.0) for k in range(30)])
    assert [d.rows.count() for d in made] == [50, 50, 50]
    with pytest.raises(ValueError, match="blocks"):
        made.add_adatas([source(spark, 8, n=10)], shuffle_chunk_size=5)
    assert made.rows().count() == 150


def test_groupby_sorts_each_dataset(spark, tmp_path):
    c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([source(spark, 0), source(spark, 1)], groupby="label", shuffle_chunk_size=5, dataset_size=40, rng=1)
    c.add_adatas([source(spark, 2)], groupby=["label"], shuffle_chunk_size=5, rng=2)
    rank = {"2": 0, "0": 1, "1": 2, None: 3}
    for d in c:
        got = [rank[r.label] for r in d.rows.sort("row_id").collect()]
        assert got == sorted(got) and got[-1] == 3


def test_groupby_errors(spark, tmp_path):
    c = DatasetCollection(f"{tmp_path}/c.parquet", spark)
    add = lambda parts, g: c.add_adatas(parts, groupby=g, shuffle_chunk_size=5, dataset_size=40)
    for parts, g, message in (
        ([source(spark, 0)], "nothing", "missing from all"), ([source(spark, 0), source(spark, 1, label=False)], "label", "missing from 1"),
        ([source(spark, 0)], [], "at least one"), ([source(spark, 0)], ["label", "label"], "repeat"),
        ([source(spark, 0), Annotated(with_categories(source(spark, 1).rows, "label", ["0", "1", "2"]), source(spark, 1).var, ["row_id"])], "label", "different categories"),
        ([source(spark, 0), Annotated(source(spark, 1).rows.withMetadata("label", {}), source(spark, 1).var, ["row_id"])], "label", "some sources only"),
    ):
        with pytest.raises(ValueError, match=message):
            add(parts, g)
    assert c.is_empty


def test_missing_keys_warn_and_are_null(spark, tmp_path):
    with pytest.warns(UserWarning, match="label"):
        c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([source(spark, 0), source(spark, 1, label=False)], shuffle_chunk_size=5, dataset_size=40)
    assert c.rows().filter("src = 1 and label is not null").count() == 0


def test_var_subset_sizes_and_paths(spark, tmp_path):
    for i in range(2):
        write_source(source(spark, i), f"{tmp_path}/s{i}")
    c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([f"{tmp_path}/s0", f"{tmp_path}/s1"], var_subset=["own1", "g0", "unknown"], shuffle_chunk_size=5, dataset_size="1KB", rng=1)
    assert [r.var_name for r in c.var.sort("var_id").collect()] == ["g0", "own1"]
    assert {n for _, n, _ in triples(c)} == {"g0", "own1"} and len(c) > 1
    with pytest.raises(ValueError, match="shuffle_chunk_size"):
        DatasetCollection(f"{tmp_path}/d.parquet", spark).add_adatas([f"{tmp_path}/s0"], shuffle_chunk_size=50, dataset_size=40)


def test_all_in_one_dataset_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="one dataset"):
        c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([source(spark, 0)], shuffle_chunk_size=15, dataset_size=20)
    assert c.dataset_ids == [0]


def test_dense_is_filled_with_nan(spark, tmp_path):
    def d(names, v):
        rows = spark.range(6).select(F.col("id").alias("row_id"), F.array(*[F.lit(float(v + i)) for i in range(len(names))]).alias("x"))
        return Annotated(rows, spark.createDataFrame(list(enumerate(names)), "var_id int, var_name string"), ["row_id"])

    c = DatasetCollection(f"{tmp_path}/c.parquet", spark).add_adatas([d(["a", "b"], 1), d(["b", "c"], 5)], shuffle=False, shuffle_chunk_size=6, dataset_size=12)
    x = np.array([r.x for r in c.rows().sort("obs_id").collect()])
    assert np.array_equal(x[0], [1, 2, np.nan], equal_nan=True) and np.array_equal(x[-1], [np.nan, 5, 6], equal_nan=True)


def test_loader_over_a_collection(spark, made):
    loader = Loader(spark, chunk_size=10, preload_nchunks=2, batch_size=20, shuffle=True, return_index=True, rng=1).use_collection(made)
    got = np.concatenate([b["index"] for b in loader])
    assert sorted(got.tolist()) == list(range(120)) and loader.n_var == 5
    with pytest.raises(RuntimeError):
        loader.use_collection(made)
    with pytest.raises(ValueError):
        Loader(spark).use_collection(DatasetCollection(made.path + "x.parquet", spark))


def test_a_collection_is_one_scan(spark, made):
    rows = Loader(spark, chunk_size=10, preload_nchunks=2, batch_size=20).use_collection(made).rows()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(made) > 1 and plan.count("FileScan parquet") == 1 and "Union" not in plan
    by = {r["dataset_id"]: (r["n"], r["lo"], r["hi"]) for r in rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.min("obs_id").alias("lo"), F.max("obs_id").alias("hi")).collect()}
    at = 0
    for k in made.dataset_ids:
        n = made.dataset(k).rows.count()
        assert by[k] == (n, at, at + n - 1)
        at += n


def test_one_dataset_reads_one_partition(spark, made):
    plan = made.dataset(1).rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_stream_appends(spark, made, tmp_path):
    src = source(spark, 9, n=30)
    src.rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.rows.schema).parquet(f"{tmp_path}/in")
    append_stream(stream, made, f"{tmp_path}/ckpt", var=src.var, order=["row_id"], shuffle_chunk_size=5).awaitTermination()
    assert made.rows().count() == 150


def test_modes(spark, tmp_path, made):
    with pytest.raises(TypeError):
        DatasetCollection(3, spark)
    with pytest.raises(ValueError):
        DatasetCollection(made.path, spark, mode="r").add_adatas([source(spark, 0)])


def test_sizes(spark, tmp_path):
    assert [parse_size(s) for s in ("1GB", "20 GiB", "1.5k", 7)] == [1 << 30, 20 << 30, 1536, 7]
    with pytest.raises(ValueError):
        parse_size("many")
    assert dense_layout(10, 3, 20) == (3, 9) and dense_layout(10, 5, 20) == (5, 10) and rows_of("1KB", 100) == 10
    assert sparse_layout(10, 50, 2, 4) == (10, 20)
    with pytest.raises(ValueError):
        dense_layout(0, 3, 20)
    rows = spark.range(25).select(F.col("id").alias("pos"), F.col("id").alias("x"))
    assert write_sharded(rows, f"{tmp_path}/w", n_obs_per_chunk=5, shard_size=12) == 10
    per_file = spark.read.parquet(f"{tmp_path}/w").groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [5, 10, 10]


def test_a_crash_between_two_steps_leaves_a_state(spark, made, monkeypatch):
    """Stopped after the data are written, after the aside file is, and after the rename: the old state, the old one, the new one."""
    from tessera import collection
    from tessera.sources import scan

    before = made.manifest

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(collection, "write_state", stop)
    with pytest.raises(KeyboardInterrupt):
        made.add_adatas([source(spark, 7, n=30)], shuffle_chunk_size=5, rng=3)
    assert made.manifest == before and made.rows().count() == 120
    monkeypatch.undo()

    f, p = scan.fs(spark, f"{made.path}/_manifest-00000002.half.new")
    f.create(p, True).close()
    assert made.manifest == before and not made.is_empty

    monkeypatch.setattr(made, "_delete", stop)
    with pytest.raises(KeyboardInterrupt):
        made.add_adatas([source(spark, 7, n=30)], shuffle_chunk_size=5, rng=3)
    assert made.rows().count() == 150
    monkeypatch.undo()
    assert made.add_adatas([source(spark, 8, n=30)], shuffle_chunk_size=5, rng=3).rows().count() == 180


def test_a_replayed_batch_is_added_once(spark, made):
    for number, n in ((0, 150), (0, 150), (1, 180), (1, 180), (0, 180)):
        made.add_adatas([source(spark, 9, n=30)], shuffle_chunk_size=5, batch=("stream", number))
        assert made.rows().count() == n
    assert made.add_adatas([source(spark, 9, n=30)], shuffle_chunk_size=5, batch=("other", 0)).rows().count() == 210


def test_names_become_unique(spark, monkeypatch):
    from tessera.operators import align

    monkeypatch.setattr(align, "NAME_BLOCK", 7)
    rows = spark.range(60).select((F.col("id") % 2).alias("src"), F.col("id"), F.when(F.col("id") % 9 == 8, None).when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 30).cast("string"))).alias("name"))
    seen, want = {}, []
    for r in sorted(rows.collect(), key=lambda r: (r.src, r.id)):
        k = seen[r.name] = seen.get(r.name, -1) + 1
        want.append((r.src, r.id, f"{r.name}-{k}" if k and r.name is not None else r.name))
    assert sorted(tuple(r) for r in align.make_unique(rows, "name", ["src", "id"]).collect()) == want


def test_small_datasets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tessera.sources import sink

    monkeypatch.setattr(sink, "TASK_ROWS", 10)
    rows = spark.range(60).select((F.col("id") % 6).cast("int").alias("dataset_id"), F.floor(F.col("id") / 6).alias("pos"), F.col("id").alias("x"))
    write_sharded(rows, f"{tmp_path}/w", dataset="dataset_id", n_obs_per_chunk=5)
    files = spark.read.parquet(f"{tmp_path}/w").groupBy("dataset_id", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).count().collect()
    assert sorted((r["dataset_id"], r["count"]) for r in files) == [(k, 10) for k in range(6)]
    assert len({r["task"] for r in files}) > 2


def test_small_datasets_are_ranked_without_ranges(spark):
    from tessera.plans.blocks import place

    rows = spark.range(40).select("id", F.col("id").alias("row_id"), F.floor(F.col("id") / 10).cast("int").alias("dataset_id"))
    small, large = (place(rows, seed=1, shuffle=True, sort=[], ids=["row_id"], n_rows=n, n_datasets=k) for n, k in ((8_000_000, 20_000), (8_000_000, 1)))
    assert "Join" not in small._jdf.queryExecution().optimizedPlan().toString()  # the table of ranges would have as many rows as the input
    assert sorted((r.id, r.dataset_id, r.pos) for r in small.collect()) == sorted((r.id, r.dataset_id, r.pos) for r in large.collect())

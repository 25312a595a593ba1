from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import align


def var(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "var_id int, var_name string")


def sparse(spark):
    """Rows of 0 to 4 features in any order, a null row, numbers beyond the features, a null number, a number twice."""
    rows = [(0, [4, 0, 2], [1.0, 2.0, 3.0]), (1, [], []), (2, None, None), (3, [1, 9, -1], [4.0, 5.0, 6.0]), (4, [3, None, 3, 0], [8.0, 1.0, 7.0, None]), (5, [0], [9.0])]
    made = spark.createDataFrame(rows, "row_id long, i array<int>, v array<double>")
    return made.select("row_id", F.when(F.col("i").isNotNull(), F.struct(F.col("i").alias("indices"), F.col("v").alias("values"))).alias("x"), F.struct(F.col("i").alias("indices"), F.col("v").alias("values")).alias("layer_y"))


def got(df):
    return sorted((r.row_id, r.x, r.layer_y) for r in df.collect())


@pytest.mark.parametrize("entries", [32_000_000, 0])
def test_a_map_beyond_a_constant_gives_the_same_rows(spark, monkeypatch, entries):
    old, new = var(spark, ["a", "b", "c", "d", "e"]), var(spark, ["e", "d", "zz", "a"])
    want = got(align.remap(sparse(spark), old, new, ["x", "layer_y"]))
    monkeypatch.setattr(align, "LITERAL_ENTRIES", 1)
    monkeypatch.setattr(align, "MAP_ENTRIES", entries)
    far = align.remap(sparse(spark), old, new, ["x"] if not entries else ["x", "layer_y"])
    if entries:
        assert got(far) == want
    else:  # a struct of two nulls has no elements to join
        assert [r[:2] for r in got(far)] == [r[:2] for r in want]
    assert "NestedLoop" not in far._jdf.queryExecution().executedPlan().toString()  # no row carries the map


def test_many_names_of_a_subset_are_a_join(spark):
    whole = var(spark, [f"n{i}" for i in range(3000)])
    part = align.subset_var(whole, [f"n{i}" for i in range(5000, 0, -2)])
    assert [(r.var_id, r.var_name) for r in part.sort("var_id").collect()] == [(k, f"n{i}") for k, i in enumerate(range(2, 3000, 2))]
    assert "n1000" not in part._jdf.queryExecution().optimizedPlan().toString()  # names are no constants of the plan

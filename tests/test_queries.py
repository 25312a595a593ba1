from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__ as driver
from conftest import SMALL
from tessera.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, SMALL, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_row_joins_are_equi_joins(spark):
    plan = QUERIES["random_batches"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan

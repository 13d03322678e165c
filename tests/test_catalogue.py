"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import SMALL, rows_of, rows_of_sql

import __spark_entry__
from tellurix.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name not in ORACLE_SQL:
        assert df.count() > 0
        return
    columns, rows = rows_of_sql(ORACLE_SQL[name], SMALL)
    assert sorted(df.columns) == columns
    assert rows_of(df) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_and_columns_reach_the_scan(spark):
    df = QUERIES["projection_filter"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan
    assert "ReadSchema" in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_sketches_keep_their_error(spark):
    exact = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/events.parquet").groupBy("event_type").count().collect()}
    for r in QUERIES["approximate"](spark, SMALL).collect():
        assert abs(r.about_n - exact[r.event_type]) <= 0.1 * exact[r.event_type]
        assert abs(r.hll_n - exact[r.event_type]) <= 0.1 * exact[r.event_type]


def test_join_hints_choose_the_join(spark):
    plan = QUERIES["join_hints"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin"))

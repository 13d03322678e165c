"""The subpackage's queries against DuckDB where SQL can express them; and what holds for all of them."""

from __future__ import annotations

import pytest
from helpers import SMALL, rows_of, rows_of_sql

from tellurix.llm.queries import ORACLE_SQL, QUERIES

NATIVE = ("op2_tool_call_linking", "op4_mixing")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns, rows = rows_of_sql(ORACLE_SQL[name], SMALL)
    assert sorted(df.columns) == columns
    assert rows_of(df) == rows


def test_thirteen_operators_and_the_pipeline():
    assert {x.split("_")[0] for x in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    seen = []

    def watch(self, df, label, original=None):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(self, df, label)

    from tellurix.llm.common import Scratch

    before = Scratch.table
    Scratch.table = lambda self, df, label: watch(self, df, label, before)
    try:
        seen.append(QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    finally:
        Scratch.table = before
    assert not [p for p in seen if any(x in p for x in ("Python", "Pandas", "Arrow"))]

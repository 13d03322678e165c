"""Orders within groups that no task has as a whole, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tellurix.operators import ranks
from tellurix.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"


def rows_of(r, n, kinds):
    return [(r.choice(["a", "a", "a", "b", None]), r.choice(kinds)()) for _ in range(n)]


@pytest.mark.parametrize("kind", ["many values", "ties"])
def test_cumulative(spark, kind):
    r = random.Random(kind)
    rows = rows_of(r, 2000, [lambda: r.gauss(0, 1) if kind == "many values" else float(r.randint(0, 3)), lambda: None])
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    out = ranks.cumulative(df, ["k"], "v", {"n": F.lit(1)}).collect()
    of = {}
    for k, v in rows:
        if v is not None:
            of.setdefault(k, []).append(v)
    want = {(k, v): (own.count(v), sum(x < v for x in own), len(own)) for k, own in of.items() for v in set(own)}
    assert {(x.k, x.v): (x.n, x.n_below, x.n_all) for x in out} == want and len(out) == len(want)


def test_cumulative_over_all_rows_and_none(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (2,)], "v int")
    assert [(x.v, x.n, x.n_below, x.n_all) for x in ranks.cumulative(df, [], "v", {"n": F.lit(1)}).orderBy("v").collect()] == [(1, 2, 0, 4), (2, 1, 2, 4), (3, 1, 3, 4)]
    assert ranks.cumulative(df.where("v > 5"), [], "v", {"n": F.lit(1)}).count() == 0


def test_quantiles_are_sparks_own(spark):
    r = random.Random(4)
    rows = rows_of(r, 1500, [lambda: r.gauss(0, 1), lambda: float(r.randint(0, 2)), lambda: None]) + [("one", 7.0), ("two", 1.0), ("two", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"lo": 0.0, "q": 0.25, "m": 0.5, "x": 0.9, "hi": 1.0}
    own = ranks.quantiles(df, ["k"], "v", at).collect()
    want = {x.k: x for x in df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()]).collect()}
    assert {x.k for x in own} == set(want) - {"none"}
    for x in own:
        assert all(x[n] == want[x.k][n] or abs(x[n] - want[x.k][n]) < 1e-12 for n in at)


def test_count_above(spark):
    r = random.Random(5)
    a, b = ([(*x, i) for i, x in enumerate(rows_of(r, n, [lambda: float(r.randint(0, 50)), lambda: None]))] for n in (200, 500))
    left, right = (spark.createDataFrame(x, "k string, v double, id int") for x in (a, b))
    out = {x.id: x.n for x in ranks.count_above(left, right.withColumnRenamed("v", "u"), ["k"], "v", "u", "n").collect()}
    assert out == {i: sum(k is not None and v is not None and u is not None and k == l and u > v for l, u, _ in b) for k, v, i in a}


@pytest.mark.parametrize("name", ["percentiles", "quantile_errors", "roc_area", "theta_join"])
def test_no_group_meets_in_one_task_and_no_pair_is_formed(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    assert not any("c_acctbal" in line for line in plan.splitlines() if "Join" in line)

"""Pairing and scores against values worked out by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tellurix.functions import scores
from tellurix.operators import pairing

T = datetime(2024, 1, 1)


def at(minutes):
    return T + timedelta(minutes=minutes)


def test_as_of_counts_the_same_instant_and_leaves_early_rows_null(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(10)), (3, "a", at(1)), (4, "b", at(9)), (5, None, at(9))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(7), 2.0), ("a", at(7), None), ("b", at(10), 9.0)], "k string, t timestamp, v double")
    out = {r.id: r.x for r in pairing.as_of(left, right, ["k"], "t", "v", "x").collect()}
    assert out == {1: 1.0, 2: 2.0, 3: None, 4: None, 5: None}


def test_within_takes_both_ends_across_buckets(spark):
    left = spark.createDataFrame([(1, "a", at(60)), (2, "a", at(61)), (3, "b", at(60))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(0), 1), ("a", at(60), 2), ("a", at(61), 3)], "k string, u timestamp, v int")
    pairs = {(r.id, r.v) for r in pairing.within(left, right, ["k"], "t", "u", 3600).collect()}
    assert pairs == {(1, 1), (1, 2), (2, 2), (2, 3)}


def test_persistence(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("b", 1, 7.0)], "k string, t int, v double")
    assert sorted((r.k, r.f, r.o) for r in pairing.persistence(df, ["k"], ["t"], "v").where("f is not null").collect()) == [("a", 3.0, 5.0)]


def spread(r, n):
    """Rows of few keys over 30 years, some at once, some at the same instants, some without key, time or value."""
    at_ = lambda: None if r.random() < 0.02 else datetime(1960, 1, 1) + timedelta(hours=r.choice([r.randint(0, 270_000), r.randint(90_000, 90_030)]))
    return [(i, r.choice(["a", "a", "a", "b", None]), at_(), r.choice([None, float(r.randint(0, 9))])) for i in range(n)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int"])
def test_keys_cut_into_buckets_give_the_rows_of_one_window_a_key(spark, kind):
    r = random.Random(kind)
    schema, to = "id int, k string, t timestamp_ntz, v double", "datediff(t, date'1970-01-01')" if kind == "int" else f"cast(t as {kind})"
    left, right = (spark.createDataFrame(spread(r, n), schema).withColumn("t", F.expr(to)) for n in (300, 400))
    w = Window.partitionBy("k").orderBy("t", "_side", F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.select("id", "k", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("_side")).unionByName(right.select("id", "k", "t", "v", F.lit(0).alias("_side")))
    want = {x.id: x.x for x in both.withColumn("x", F.last("v", ignorenulls=True).over(w)).where("_side = 1").collect()}
    for length in (7, 86400):
        assert {x.id: x.x for x in pairing.as_of(left, right, ["k"], "t", "v", "x", length).collect()} == want
        plain = right.select("id", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")).alias("f"), "v")
        assert sorted(map(repr, (tuple(x) for x in pairing.persistence(right, ["k"], ["t", "id"], "v", ["id"], length).select("id", "f", "o").collect()))) == sorted(repr(tuple(x)) for x in plain.collect())


def test_one_key_makes_many_tasks(spark):
    """Nothing is dealt out by the key alone, and the only key's rows lie in most partitions of the result."""
    df = spark.range(20000).select((F.col("id") % 1).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (pairing.persistence(df, ["k"], ["t"], "v"), pairing.as_of(df, df, ["k"], "t", "v", "x")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            dealt = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
            assert dealt and all(x.count("#") > 1 for x in dealt)
            assert out.groupBy(F.spark_partition_id()).count().where("count > 1000").count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_other_orders_are_refused(spark):
    with pytest.raises(ValueError):
        pairing.persistence(spark.createDataFrame([("a", "b", 1.0)], "k string, t string, v double"), ["k"], ["t"], "v")


def test_deterministic_leaves_out_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 1.0), (float("nan"), 1.0), (5.0, 5.0)], "f double, o double")
    r = scores.deterministic(df, by=[]).first()
    assert (r.n, r.bias, r.mae, r.rmse) == (3, 0.0, round(2 / 3, 6), round((2 / 3) ** 0.5, 6))


def test_skill_of_a_perfect_and_of_a_constant_reference(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0, 2.0), ("x", 3.0, 3.0, 2.0), ("y", 1.0, 2.0, 2.0)], "s string, f double, o double, c double")
    assert {r.s: r.skill for r in scores.skill(df, ["s"]).collect()} == {"x": 1.0, "y": None}


def test_contingency_without_forecast_events_has_no_precision(spark):
    df = spark.createDataFrame([(False, True), (False, False), (None, True)], "f boolean, o boolean")
    r = scores.contingency(df, []).first()
    assert (r.hits, r.false_alarms, r.misses, r.correct_negatives, r.precision, r.recall) == (0, 0, 1, 1, None, 0.0)


def test_auc_gives_ties_half(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "p double, y int")
    assert scores.auc(df).first().auc == 0.875
    assert scores.auc(df.where("y = 1")).first().auc is None
    close = spark.createDataFrame([(0.50001, 1), (0.50002, 0), (0.50003, 1), (0.2, None), (None, 1)], "p double, y int")
    assert scores.auc(close).first().auc == 0.5


def test_reliability_puts_one_into_the_last_bin(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 0), (0.0, 0)], "p double, y int")
    assert {r.bin: (r.n, r.observed) for r in scores.reliability(df).collect()} == {9: (2, 0.5), 0: (1, 0.0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "f double, o double")
    assert scores.deterministic(none, []).first().n == 0
    assert scores.weighted_mean(spark.createDataFrame([(1, 2.0)], "k int, v double"), "v", F.lit(0.0), ["k"]).first()["mean"] is None

"""Samples and sketches: the same each time, and as near to the whole as is said."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tellurix.operators import sampling, sketches


def population(spark):
    r = random.Random(1)
    rows = [(i, r.choice("aab"), r.paretovariate(1.2)) for i in range(4000)] + [(9000 + i, "few", float(i)) for i in range(5)] + [(9100, "b", None), (9101, None, 2.0)]
    return spark.createDataFrame(rows, "id int, s string, x double")


def test_exactly_k_of_each_stratum_and_the_same_ones_however_dealt_out(spark):
    df = population(spark)
    one = sampling.prioritised(df.repartition(3), ["s"], 100, "x", ["id"], "q")
    two = sampling.prioritised(df.repartition(7, "x"), ["s"], 100, "x", ["id"], "q")
    assert {r.s: r["count"] for r in one.groupBy("s").count().collect()} == {"a": 100, "b": 100, "few": 4, None: 1}
    rows = lambda t: sorted(repr(tuple(r)) for r in t.collect())
    assert rows(one) == rows(two) != rows(sampling.prioritised(df, ["s"], 100, "x", ["id"], "other"))
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()


def test_weights_add_up_to_the_stratum_within_their_error(spark):
    df = population(spark).withColumn("one", F.lit(1))
    for size in ("x", "one"):
        exact = {r.s: r.t for r in df.groupBy("s").agg(F.sum(size).alias("t")).collect()}
        for seed in ("1", "2", "3"):
            got = {r.s: r.t for r in sampling.prioritised(df, ["s"], 200, size, ["id"], seed).groupBy("s").agg(F.sum("weight").alias("t")).collect()}
            assert all(abs(got[s] - exact[s]) <= 4 * exact[s] / 199**0.5 for s in ("a", "b"))
            assert got["few"] == exact["few"]


def test_merged_sketches_keep_their_error(spark):
    df = spark.range(60000).select((F.col("id") % 20).alias("day"), (F.hash("id") % 9000).alias("u"), F.rand(3).alias("v"))
    r = sketches.merged(sketches.stored(df, ["day"], "u", "v").where("day < 10"), [], [0.1, 0.5]).first()
    part = df.where("day < 10")
    exact = part.select("u").distinct().count()
    assert r.n == 30000 and abs(r.about_distinct - exact) <= sketches.DISTINCT_ERROR * exact
    for q, at in ((0.1, r.about_q10), (0.5, r.about_q50)):
        assert abs(part.where(F.col("v") <= at).count() / 30000 - q) <= sketches.RANK_ERROR

"""Python where no built-in function has the semantics: Arrow batches, never single rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.plans.registry import query
from tellurix.sources.tables import table


@query("SELECT event_id, round(CASE WHEN value < 10 THEN 10 WHEN value > 400 THEN 400 ELSE value END, 6) AS clipped FROM events")
def pandas_scalar(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def clipped(v: pd.Series) -> pd.Series:
        return v.clip(10, 400)

    return table(spark, d, "events").select("event_id", F.round(clipped("value"), 6).alias("clipped"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def pandas_aggregate(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    # a day's part of a type is what one call gets
    parts = table(spark, d, "events").groupBy("event_type", F.to_date("ts")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    both = parts.select("event_type", F.explode(F.array("hi", "lo")).alias("v"))
    return both.groupBy("event_type").agg(F.round(spread("v"), 6).alias("spread"))


#: Rows, of all types, of a week and a block of users: a call costs some milliseconds, however few rows it gets.
ROWS = 20_000


def blocks(events: DataFrame) -> Column:
    """A number for each user, by hash, so that a block has about ROWS events in the busiest week; more only if a user has."""
    busiest = events.groupBy(F.date_trunc("week", "ts")).count().agg(F.max("count").alias("n")).first().n or 0
    return F.pmod(F.xxhash64("user_id"), F.lit(busiest // ROWS + 1))


@query("""
    SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS anomaly FROM events""")
def grouped_map(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies from each user's mean. The mean comes from an aggregate, and a call gets the events of a block of users in one week."""

    def anomalies(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": g["event_id"], "anomaly": g["value"] - g["mean"]})

    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    block = blocks(events)
    # a null user is one, too
    means = events.groupBy("user_id").agg(F.avg("value").alias("mean")).withColumnRenamed("user_id", "of")
    events = events.join(means, F.col("user_id").eqNullSafe(F.col("of"))).drop("of")
    out = events.groupBy(block.alias("block"), F.date_trunc("week", "ts").alias("week")).applyInPandas(anomalies, "event_id long, anomaly double")
    return out.select("event_id", F.round("anomaly", 9).alias("anomaly"))


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view, user_id, ts AS seen FROM events WHERE event_type = 'view'),
    n AS (SELECT event_id, view, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(seen) - epoch_us(ts)), seen, view) AS k FROM p JOIN v ON p.user_id = v.user_id AND abs(epoch_us(seen) - epoch_us(ts)) <= 21600000000)
    SELECT p.event_id, n.view FROM p LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (event_id)""")
def cogrouped_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's nearest view within six hours, before or after. A call gets the purchases of a block of
    users in one week, and the views of that week and of six hours on either side; it sorts them by user and time."""
    reach, week = 6 * 3600 * 1_000_000, 7 * 86400 * 1_000_000
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    block, bucket = blocks(events).alias("block"), lambda t: F.floor(t / week)
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "t", block, bucket(F.col("t")).alias("bucket"))
    known = F.col("user_id").isNotNull() & F.col("t").isNotNull()  # the others are near nothing
    reached = F.array_distinct(F.array(bucket(F.col("t") - reach), bucket(F.col("t") + reach)))
    views = events.where("event_type = 'view'").where(known).select("event_id", "user_id", "t", block, F.explode(reached).alias("bucket"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"event_id": a["event_id"], "view": pd.array([pd.NA] * len(a), "Int64")})
        b = b.sort_values(["user_id", "t", "event_id"], ignore_index=True)
        # the row of b at or after each one of a, in order of user and time, and where the views of its instant begin
        both = pd.concat([a[["user_id", "t"]].assign(side=0), b[["user_id", "t"]].assign(side=1)], ignore_index=True).sort_values(["user_id", "t", "side"])
        after = np.empty(len(both), np.int64)
        after[both.index] = both["side"].cumsum().to_numpy()
        after = after[: len(a)]
        seen, t, of = b["t"].to_numpy(), a["t"].to_numpy(), b["user_id"].to_numpy()
        starts = np.append(True, (of[1:] != of[:-1]) | (seen[1:] != seen[:-1]))
        instant = np.maximum.accumulate(np.where(starts, np.arange(len(b)), 0))
        before, after_ = instant[np.maximum(after - 1, 0)], np.minimum(after, len(b) - 1)
        user, far = a["user_id"].to_numpy(), np.iinfo(np.int64).max
        to_after = np.where((after < len(b)) & (of[after_] == user), np.abs(seen[after_] - t), far)
        to_before = np.where((after > 0) & (of[before] == user), np.abs(t - seen[before]), far)
        view = pd.Series(b["event_id"].to_numpy()[np.where(to_before <= to_after, before, after_)], index=a.index).astype("Int64")
        return pd.DataFrame({"event_id": a["event_id"], "view": view.mask(np.minimum(to_before, to_after) > reach)})

    both = purchases.where(known).groupBy("block", "bucket").cogroup(views.groupBy("block", "bucket"))
    return both.applyInPandas(nearest, "event_id long, view long").union(purchases.where(~known).select("event_id", F.lit(None).cast("long").alias("view")))


@query("""
    WITH m AS (SELECT user_id, ts::DATE AS day, event_id, ts, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS run FROM m),
    n AS (SELECT user_id, day, run, count(*) AS n FROM g GROUP BY ALL)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*)::INTEGER AS runs, max(n)::INTEGER AS longest FROM n GROUP BY user_id, day""")
def partitioned_table_function(spark: SparkSession, d: str) -> DataFrame:
    """Rising runs in each user's values of a day: a function over a table, partition by partition and in order, that gives its
    row when a partition ends."""

    @F.udtf(returnType="user_id long, day string, runs int, longest int")
    class Runs:
        def __init__(self):
            self.of, self.runs, self.longest, self.length, self.last = None, 0, 0, 0, None

        def eval(self, row):
            rises = self.last is not None and row["value"] is not None and row["value"] > self.last
            self.length = self.length + 1 if rises else 1
            self.runs += not rises
            self.of, self.last, self.longest = (row["user_id"], row["day"]), row["value"], max(self.longest, self.length)

        def terminate(self):
            if self.of:
                yield *self.of, self.runs, self.longest

    events = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "value")
    return Runs(events.asTable().partitionBy("user_id", "day").orderBy("ts", "event_id"))


@query("SELECT r_regionkey, (unnest(range(1, r_regionkey + 1)))::INTEGER AS i FROM region")
def table_function(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="i int")
    class UpTo:
        def eval(self, n: int):
            yield from ((i,) for i in range(1, n + 1))

    regions = table(spark, d, "region").select("r_regionkey")
    return regions.lateralJoin(UpTo(F.col("r_regionkey").outer()))

"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.functions.scores import rounded
from tellurix.operators import sketches
from tellurix.operators.ranks import quantiles
from tellurix.operators.sampling import prioritised
from tellurix.plans.registry import query
from tellurix.sources import formats
from tellurix.sources.tables import table


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_discount), 6) AS avg_disc,
           min(l_shipdate)::VARCHAR AS first_ship, max(l_quantity) AS max_qty, count(*)::BIGINT AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(price), 4).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        rounded(F.avg("l_discount"), "avg_disc"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("first_ship"), F.max("l_quantity").alias("max_qty"), F.count("*").alias("n"),
    )


@query("""
    SELECT event_type, count(*) FILTER (WHERE value > 100)::BIGINT AS high, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT ts::DATE)::BIGINT AS days
    FROM events GROUP BY event_type""")
def filtered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 100).alias("high"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days")
    )


@query("SELECT l_returnflag, l_linestatus, grouping(l_linestatus)::INTEGER AS total, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("int").alias("total"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("""
    SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
    SELECT event_type, round(var_samp(value), 6) AS var, round(stddev_pop(value), 6) AS sd, round(covar_pop(value, user_id), 6) AS cov,
           round(corr(value, user_id), 6) AS r, round(regr_slope(value, user_id), 6) AS slope, round(regr_r2(value, user_id), 6) AS r2,
           round(avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) ** 3, 2) AS m3, round(kurtosis_pop(value), 6) AS kurt
    FROM events GROUP BY event_type""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    """Skewness is given as the third central moment, skewness * sd ** 3, as engines differ in their correction of it."""
    sd = F.stddev_pop("value")
    return table(spark, d, "events").groupBy("event_type").agg(
        rounded(F.var_samp("value"), "var"), rounded(sd, "sd"), rounded(F.covar_pop("value", "user_id"), "cov"), rounded(F.corr("value", "user_id"), "r"),
        rounded(F.regr_slope("value", "user_id"), "slope"), rounded(F.regr_r2("value", "user_id"), "r2"), F.round(F.skewness("value") * sd * sd * sd, 2).alias("m3"), rounded(F.kurtosis("value"), "kurt"),
    )


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact, without a type's values in one task."""
    out = quantiles(table(spark, d, "events"), ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return out.select("event_type", *[rounded(F.col(q), q) for q in ("q25", "q50", "q90")])


@query()
def approximate(spark: SparkSession, d: str) -> DataFrame:
    """Sketches in place of exact counts and quantiles, for strata too large to sort; tests hold them to their error."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.approx_count_distinct("event_id", 0.02).alias("about_n"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id")).alias("hll_n"), F.percentile_approx("value", 0.5, 1000).alias("about_median")
    )


@query("""
    WITH e AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS w FROM events)
    SELECT strftime(w, '%Y-%m-%d') AS week, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, true AS users_within, true AS median_within FROM e GROUP BY 1, 2""")
def stored_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Users and median by week from sketches stored by day, and whether they are within the stated errors of exact ones."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = formats.kept(sketches.stored(events, ["day", "event_type"], "user_id", "value"))
    week = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.datediff("day", F.lit("2024-01-01")) / 7) * 7).cast("int"))
    about = sketches.merged(days.withColumn("week", week), ["week", "event_type"])
    exact = events.withColumn("week", week).join(about, ["week", "event_type"])
    at_most = F.avg((F.col("value") <= F.col("about_q50")).cast("int"))
    below = F.avg((F.col("value") < F.col("about_q50")).cast("int"))
    out = exact.groupBy("week", "event_type").agg(F.max("n").alias("n"), F.countDistinct("user_id").alias("users"), F.max("about_distinct").alias("about"), at_most.alias("at_most"), below.alias("below"))
    near = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1), F.col("users") * sketches.DISTINCT_ERROR)
    return out.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "n", "users", near.alias("users_within"), ((F.col("at_most") >= 0.5 - sketches.RANK_ERROR) & (F.col("below") <= 0.5 + sketches.RANK_ERROR)).alias("median_within"))


@query("""
    WITH p AS (SELECT event_id, event_type, value, value / ((('0x' || substr(md5('s1|' || event_id), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) AS priority FROM events WHERE value > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY priority DESC, event_id) AS k FROM p),
    c AS (SELECT *, max(priority) FILTER (WHERE k = 51) OVER (PARTITION BY event_type) AS cut FROM r)
    SELECT event_type, event_id, round(greatest(value, cut), 6) AS weight FROM c WHERE k <= 50""")
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events of each type, drawn by their values, the same ones each time."""
    out = prioritised(table(spark, d, "events"), ["event_type"], 50, "value", ["event_id"], "s1")
    return out.select("event_type", "event_id", rounded(F.col("weight"), "weight"))


@query("""
    SELECT c_nationkey, arg_max(c_name, (c_acctbal, c_custkey)) AS richest, arg_min(c_name, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey""")
def arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    rank = F.struct("c_acctbal", "c_custkey")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", rank).alias("richest"), F.min_by("c_name", rank).alias("poorest"))


@query("SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("r_name").agg(F.expr("listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name)").alias("nations"))


@query("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS click, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchase
    FROM events GROUP BY user_id""")
def pivoted(spark: SparkSession, d: str) -> DataFrame:
    """Pivot with its values named, so that no job has to find them."""
    out = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.count("event_id"))
    return out.fillna(0, ["click", "purchase"])


@query("""
    SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18, 2))::DECIMAL(28, 2)::VARCHAR AS total, avg(l_extendedprice::DECIMAL(18, 2))::DECIMAL(28, 2)::VARCHAR AS mean FROM lineitem GROUP BY l_returnflag""")
def decimal_sum(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    text = lambda x: x.cast("decimal(28,2)").cast("string")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(text(F.sum(price)).alias("total"), text(F.avg(price)).alias("mean"))


@query("SELECT CASE WHEN value < 50 THEN 0 WHEN value >= 450 THEN 9 ELSE floor((value - 50) / 50) + 1 END::BIGINT AS bin, count(*)::BIGINT AS n FROM events GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Bins of 50 from 50 to 450, with one for what lies below them and one above."""
    bin_ = F.width_bucket("value", F.lit(50.0), F.lit(450.0), F.lit(8))
    return table(spark, d, "events").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("""
    SELECT c_custkey, row_number() OVER w AS rn, rank() OVER b AS rk, dense_rank() OVER b AS dr, round(percent_rank() OVER b, 6) AS pr,
           round(cume_dist() OVER b, 6) AS cd, ntile(4) OVER w AS quarter
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), b AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000))""")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    w, b = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"), Window.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 1000))
    long = lambda c, name: c.cast("long").alias(name)
    return table(spark, d, "customer").select(
        "c_custkey", long(F.row_number().over(w), "rn"), long(F.rank().over(b), "rk"), long(F.dense_rank().over(b), "dr"), rounded(F.percent_rank().over(b), "pr"), rounded(F.cume_dist().over(b), "cd"), long(F.ntile(4).over(w), "quarter")
    )


@query("""
    SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first,
           nth_value(value, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
           last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def offsets(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("value").over(w).alias("first"),
        F.nth_value("value", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
        F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_purchase"),
    )


@query("""
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS moving,
           round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS day_mean
    FROM events""")
def frames(spark: SparkSession, d: str) -> DataFrame:
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    day = F.expr("avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
    return table(spark, d, "events").select("event_id", rounded(F.sum("value").over(rows), "moving"), rounded(day, "day_mean"))

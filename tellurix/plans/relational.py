"""Projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.functions.scores import rounded
from tellurix.operators import pairing, ranks
from tellurix.plans.registry import query
from tellurix.sources import formats
from tellurix.sources.tables import table


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS revenue,
           CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'pack' ELSE 'unit' END AS lot
    FROM lineitem WHERE l_quantity > 45 AND l_shipdate > TIMESTAMP '1999-01-01'""")
def projection_filter(spark: SparkSession, d: str) -> DataFrame:
    """Computed and conditional columns over a filter that reaches the Parquet scan."""
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").where((q > 45) & (F.col("l_shipdate") > F.lit("1999-01-01").cast("timestamp_ntz")))
    lot = F.when(q >= 40, "bulk").when(q >= 10, "pack").otherwise("unit")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue"), lot.alias("lot"))


@query("""
    SELECT event_id, round(value / nullif(event_id % 3, 0), 6) AS share, TRY_CAST(event_type AS INTEGER) AS as_number,
           TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def safe_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Divisions and casts that give null where they are undefined."""
    return table(spark, d, "events").select(
        "event_id", rounded(F.try_divide("value", F.col("event_id") % 3), "share"), F.col("event_type").try_cast("int").alias("as_number"), F.get_json_object("props", "$.k").try_cast("int").alias("k")
    )


@query("""
    SELECT n_name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 4) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name""")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Four tables; Spark sends the small ones to all tasks by their size, and joins the large ones on their key."""
    asia = table(spark, d, "region").where("r_name = 'ASIA'").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def left_semi(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def left_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""
    SELECT s.s_suppkey, count(*)::BIGINT AS richer FROM supplier s JOIN customer c ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal
    GROUP BY s.s_suppkey""")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """An inequality beside an equality, of which only the number of matches is asked: by ranks, without any pair."""
    poorer = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    out = ranks.count_above(poorer, table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], "s_acctbal", "c_acctbal", "richer")
    return out.where("richer > 0").select("s_suppkey", "richer")


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, v.value AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the value of the user's last view before it."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    purchases, views = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'view'")
    return pairing.as_of(purchases, views, ["user_id"], "ts", "value", "last_view").select("event_id", "last_view")


@query("""
    SELECT e.event_id, count(*)::BIGINT AS before, round(sum(c.value), 6) AS total
    FROM events e JOIN events c ON e.user_id = c.user_id AND c.ts BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts
    WHERE e.event_type = 'error' AND c.event_type = 'click' GROUP BY e.event_id""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Errors with the clicks of the six hours before them."""
    events = table(spark, d, "events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), "value")
    return pairing.within(errors, clicks, ["user_id"], "ts", "click_ts", 6 * 3600).groupBy("event_id").agg(F.count("*").alias("before"), rounded(F.sum("value"), "total"))


@query("""
    WITH s AS (SELECT s_nationkey AS k, count(*)::BIGINT AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
    c AS (SELECT c_nationkey AS k, count(*)::BIGINT AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    SELECT coalesce(s.k, c.k) AS nation, suppliers, customers FROM s FULL JOIN c ON s.k = c.k""")
def full_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full")


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05 GROUP BY o_orderkey")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    out = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of fixed size."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each task keeps its own 20; the feature is the limit."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""
    SELECT c_mktsegment, c_custkey, c_acctbal FROM (
      SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""")
def top_per_segment(spark: SparkSession, d: str) -> DataFrame:
    """Spark cuts each group to its best rows before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersectAll(table(spark, d, "customer").select("c_nationkey"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def intersect_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("""
    SELECT c_nationkey AS nation, count(*)::BIGINT AS orders, count(DISTINCT c_custkey)::BIGINT AS customers FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_hints(spark: SparkSession, d: str) -> DataFrame:
    """Sorted merge of two large sides, a hash table of the side that is known to be the smaller, and a broadcast of a
    table of fixed size."""
    nations = table(spark, d, "nation").hint("shuffle_hash").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    both = table(spark, d, "orders").hint("merge").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = both.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"))
    return counts.join(nations.hint("shuffle_hash"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("nation"), "orders", "customers")


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT user_id, event_type FROM events EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE value > 300")
def except_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    return e.select("user_id", "event_type").subtract(e.where("value > 300").select("user_id", "event_type"))


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'purchase'")
def partitioned_files(spark: SparkSession, d: str) -> DataFrame:
    """Events written in folders by type, and one folder read back: the filter leaves the others unread."""
    path = formats.shared_folder(spark)
    formats.write(table(spark, d, "events").select("event_id", "user_id", "value", "event_type"), path, by=["event_type"])
    return formats.read(spark, path).where("event_type = 'purchase'")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def text_formats(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers through CSV, JSON and ORC, with the schema declared each time."""
    df, path, schema = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), formats.shared_folder(spark), "s_suppkey long, s_name string, s_acctbal double"
    for kind in ("csv", "json", "orc"):
        formats.write(df, f"{path}/{kind}", kind)
        df = formats.read(spark, f"{path}/{kind}", kind, schema)
    return df.where("s_acctbal > 0")

"""Evaluation pipelines: load, pair, score, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.functions import scores
from tellurix.operators import pairing
from tellurix.plans.registry import query
from tellurix.sources.tables import table

PERSISTENCE = "SELECT event_type, value AS o, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f FROM events"
JUDGED = "SELECT lang, source, quality, toxic, n_chars, least(n_chars / 10000.0, 1.0) AS p FROM documents JOIN labels USING (doc_id)"


def persistence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.persistence(table(spark, d, "events"), keys=["user_id", "event_type"], order=["ts", "event_id"], value="value")


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a probability `p` made from their length, which stands in for a forecast."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.withColumn("p", F.least(F.col("n_chars") / 10000.0, F.lit(1.0)))


@query(f"""
    SELECT event_type, count(*)::BIGINT AS n, round(avg(f - o), 6) AS bias, round(avg(abs(f - o)), 6) AS mae,
           round(sqrt(avg((f - o) * (f - o))), 6) AS rmse, round(corr(f, o), 6) AS r
    FROM ({PERSISTENCE}) WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY event_type""")
def persistence_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well the value before predicts a user's next one, by event type."""
    return scores.deterministic(persistence_pairs(spark, d), by=["event_type"])


@query(f"""
    WITH c AS (SELECT event_type, avg(value) AS c FROM events GROUP BY event_type)
    SELECT event_type, count(*)::BIGINT AS n, round(1 - sum((f - o) * (f - o)) / nullif(sum((c - o) * (c - o)), 0), 6) AS skill
    FROM ({PERSISTENCE}) JOIN c USING (event_type) WHERE f IS NOT NULL GROUP BY event_type""")
def climatology_skill(spark: SparkSession, d: str) -> DataFrame:
    """Persistence against each type's mean."""
    mean = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("c"))
    return scores.skill(persistence_pairs(spark, d).join(mean, "event_type"), by=["event_type"])


@query(f"""
    WITH t AS (SELECT lang, p >= 0.2 AS f, quality = 1 AS o FROM ({JUDGED})),
    s AS (SELECT lang, count(*) FILTER (WHERE f AND o)::BIGINT AS hits, count(*) FILTER (WHERE f AND NOT o)::BIGINT AS false_alarms,
                 count(*) FILTER (WHERE NOT f AND o)::BIGINT AS misses, count(*) FILTER (WHERE NOT f AND NOT o)::BIGINT AS correct_negatives FROM t GROUP BY lang)
    SELECT *, round(hits / nullif(hits + false_alarms, 0), 6) AS precision, round(hits / nullif(hits + misses, 0), 6) AS recall,
           round(2 * hits / nullif(2 * hits + false_alarms + misses, 0), 6) AS f1 FROM s""")
def contingency_table(spark: SparkSession, d: str) -> DataFrame:
    pairs = judged(spark, d).select("lang", (F.col("p") >= 0.2).alias("f"), (F.col("quality") == 1).alias("o"))
    return scores.contingency(pairs, by=["lang"])


@query(f"SELECT lang, count(*)::BIGINT AS n, round(avg((p - quality) ** 2), 6) AS brier FROM ({JUDGED}) GROUP BY lang")
def brier_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.brier(judged(spark, d).withColumn("y", F.col("quality")), by=["lang"])


@query(f"""
    SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS observed FROM ({JUDGED}) GROUP BY 1""")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return scores.reliability(judged(spark, d).withColumn("y", F.col("quality")))


@query("""
    SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal * cos(radians(c_nationkey * 3))) / nullif(sum(cos(radians(c_nationkey * 3))), 0), 6) AS mean
    FROM customer GROUP BY c_mktsegment""")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """The nation's number stands in for a latitude."""
    return scores.weighted_mean(table(spark, d, "customer"), "c_acctbal", F.cos(F.radians(F.col("c_nationkey") * 3)), by=["c_mktsegment"])


@query(f"""
    WITH s AS (SELECT p AS s, quality AS y FROM ({JUDGED})),
    c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY s),
    w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM c)
    SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(wins) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM w""")
def roc_area(spark: SparkSession, d: str) -> DataFrame:
    return scores.auc(judged(spark, d).withColumn("y", F.col("quality")))


@query(f"""
    SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(f, 0.1) - quantile_cont(o, 0.1), 6) AS q10, round(quantile_cont(f, 0.5) - quantile_cont(o, 0.5), 6) AS q50,
           round(quantile_cont(f, 0.9) - quantile_cont(o, 0.9), 6) AS q90
    FROM ({PERSISTENCE}) WHERE f IS NOT NULL GROUP BY event_type""")
def quantile_errors(spark: SparkSession, d: str) -> DataFrame:
    return scores.quantile_error(persistence_pairs(spark, d), by=["event_type"])


@query(f"""
    SELECT lang, source, grouping(lang, source)::INTEGER AS level, count(*)::BIGINT AS n, round(avg((p - quality) ** 2), 6) AS brier FROM ({JUDGED}) GROUP BY CUBE (lang, source)""")
def stratified_report(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores by language and source with all totals, in one aggregation."""
    return pairing.stratified(judged(spark, d), ["lang", "source"], [F.count("*").alias("n"), scores.rounded(F.avg((F.col("p") - F.col("quality")) ** 2), "brier")])


@query(f"SELECT source, count(*)::BIGINT AS n, round(avg((p - quality) ** 2), 6) AS brier FROM ({JUDGED}) GROUP BY source ORDER BY brier DESC, source LIMIT 5")
def worst_strata(spark: SparkSession, d: str) -> DataFrame:
    return scores.brier(judged(spark, d).withColumn("y", F.col("quality")), by=["source"]).orderBy(F.desc("brier"), "source").limit(5)

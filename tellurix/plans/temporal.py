"""Windows in time, in their batch form: the same transformations that run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tellurix.operators import pairing
from tellurix.plans.registry import query
from tellurix.sources import formats
from tellurix.sources.tables import table
from tellurix.streaming import sinks, verification

TEXT = "yyyy-MM-dd HH:mm:ss"
PAIRS = "SELECT ts, event_type, value AS o, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    out = pairing.persistence(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", keep=["ts", "event_type"])
    return out.select("ts", "event_type", "f", "o").where("f is not null")


@query(f"""
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n, round(avg(abs(f - o)), 9) AS mae
    FROM ({PAIRS}) WHERE f IS NOT NULL GROUP BY 1""")
def tumbling_scores(spark: SparkSession, d: str) -> DataFrame:
    out = verification.scores_by_window(pairs(spark, d), "ts", "1 day")
    return out.select(F.date_format("start", TEXT).alias("start"), "n", "mae")


@query(f"""
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n, round(avg(f - o), 9) AS bias
    FROM (SELECT f, o, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM ({PAIRS}) WHERE f IS NOT NULL) GROUP BY 1""")
def sliding_scores(spark: SparkSession, d: str) -> DataFrame:
    out = verification.scores_by_window(pairs(spark, d), "ts", "12 hours", "6 hours")
    return out.select(F.date_format("start", TEXT).alias("start"), "n", "bias")


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = verification.sessions(table(spark, d, "events"), "ts", "12 hours", "user_id")
    return out.select("user_id", F.date_format("start", TEXT).alias("start"), "n")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return formats.stream(spark, d, table(spark, d, "events").schema, names="events.parquet")


@query("""
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(avg(100 - value), 9) AS bias
    FROM events GROUP BY 1, 2""")
def streamed_scores(spark: SparkSession, d: str) -> DataFrame:
    """A constant forecast scored by day on a stream: in complete mode the batch form's rows."""
    pairs = event_stream(spark, d).select("ts", "event_type", F.lit(100.0).alias("f"), F.col("value").alias("o"))
    scored, folder = verification.scores_by_window(pairs, "ts", "1 day", by=["event_type"]), formats.shared_folder(spark)
    sinks.by_batch(scored, folder, lambda batch, _: {"rows": batch}, "complete").awaitTermination()
    out = sinks.rows(spark, f"{folder}/rows", StructType([*scored.schema, StructField("batch", LongType())]))
    last = out.agg(F.max("batch").alias("batch"))  # in complete mode each batch is the whole result
    return out.join(last, "batch").select(F.date_format("start", TEXT).alias("start"), "event_type", "n", "bias")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS ids FROM events")
def streamed_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, though the stream brings it twice."""
    twice = event_stream(spark, d).select("ts", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    first, folder = verification.once(twice, "ts", ["event_id"]).select("event_id"), formats.shared_folder(spark)
    sinks.to_parquet(first, folder).awaitTermination()
    return sinks.rows(spark, f"{folder}/rows", first.schema).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


#: Blocks of users whose sessions are kept together.
BLOCKS = 512
#: Staged events come up to so many hours after their time, event by event, in SLICES of ten days of arrival.
DELAYS, SLICES = 72, 4
SLICE = f"least(floor(epoch(ts + to_hours((event_id % {DELAYS})::INTEGER) - TIMESTAMP '2024-01-01') / 864000), {SLICES - 1})"


def arrivals(spark: SparkSession, d: str, types: tuple[str, ...] = ()) -> list[DataFrame]:
    """Events in the order in which they come, out of order in time; and at last one of each type from a user of number -1 a
    year later, which closes everything before it."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events = events.where(F.col("event_type").isin(*types)) if types else events
    comes = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % DELAYS * 3600 - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    slice_ = F.least(F.floor(comes / 864000), F.lit(SLICES - 1))
    end = events.groupBy("event_type").agg(F.lit(-1).cast("long").alias("event_id"), F.max("ts").alias("ts"))
    end = end.select("event_id", (F.col("ts") + F.expr("interval 1 year")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), "event_type", F.lit(0.0).alias("value"))
    return [*(events.where(slice_ == i) for i in range(SLICES)), end]


@query("""
    SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Totals by day, of which each batch writes those that it changed; the last of each is the table's state."""
    folder = formats.shared_folder(spark)

    def start(stream: DataFrame) -> StreamingQuery:
        day = verification.timed(stream.where("user_id >= 0"), "ts", "30 days").groupBy(F.window("ts", "1 day"), "event_type")
        totals = day.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
        return sinks.by_batch(totals, folder, lambda batch, _: {"rows": batch}, "update")

    sinks.fed(arrivals(spark, d), folder, start)
    out = sinks.latest(sinks.rows(spark, f"{folder}/rows", "start timestamp, event_type string, n long, total double, batch long"), ["start", "event_type"])
    return out.select(F.date_format("start", TEXT).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""
    WITH s AS (SELECT event_id, ts, {SLICE} AS slice FROM events),
    m AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s GROUP BY slice)
    SELECT event_id, coalesce(ts < newest - INTERVAL 1 DAY, false) AS late FROM s JOIN m USING (slice)""")
def streamed_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events that come more than a day behind the newest of the batches before, in a table of their own."""
    folder = formats.shared_folder(spark)
    frames = arrivals(spark, d)
    sinks.fed(frames, folder, lambda stream: sinks.by_batch(stream, folder, sinks.late_apart("ts", "1 day", folder)))
    both = [sinks.rows(spark, f"{folder}/{name}", frames[0].schema).where("user_id >= 0").select("event_id", F.lit(name == "late").alias("late")) for name in ("on_time", "late")]
    return both[0].unionByName(both[1])


@query("""
    SELECT v.event_id AS view, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'view') v
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR""")
def streamed_outer_match(spark: SparkSession, d: str) -> DataFrame:
    """Views with the purchases of the six hours after them; views without any are emitted when the watermark has passed."""
    folder = formats.shared_folder(spark)

    def start(stream: DataFrame) -> StreamingQuery:
        side = lambda kind, t, v: stream.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias(t), F.col("event_id").alias(v))
        return sinks.to_parquet(verification.matched(side("view", "ft", "f"), side("purchase", "ot", "o"), "user_id", 6 * 3600, f"{DELAYS + 240} hours", "left_outer"), folder)

    sinks.fed(arrivals(spark, d, ("view", "purchase")), folder, start)
    out = sinks.rows(spark, f"{folder}/rows", "user_id long, ft timestamp, ot timestamp, f long, o long").where("user_id >= 0")
    return out.select(F.col("f").alias("view"), F.col("o").alias("purchase"))


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*)::BIGINT AS n FROM g GROUP BY user_id, s""")
def streamed_timed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events that come out of order, closed by timers, of which a block of users has one at a time."""
    folder, name = formats.shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sinks.fed(arrivals(spark, d), folder, lambda stream: sinks.to_parquet(verification.timed_sessions(stream, "ts", 12 * 3600, "user_id", f"{DELAYS + 240} hours", BLOCKS), folder))
    finally:
        spark.conf.set(name, before)
    out = sinks.rows(spark, f"{folder}/rows", "key string, start long, last long, n long")
    return out.select(F.col("key").cast("long").alias("user_id"), "start", "last", "n").where("user_id >= 0")

"""Scalar functions: dates, numbers, strings, JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.functions.scores import rounded
from tellurix.plans.registry import query
from tellurix.sources.tables import table


@query("""
    SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, month(o_orderdate)::INTEGER AS m, dayofyear(o_orderdate)::INTEGER AS doy,
           week(o_orderdate)::INTEGER AS w, (dayofweek(o_orderdate) + 1)::INTEGER AS dow, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS age,
           (o_orderdate + INTERVAL 36 HOUR)::VARCHAR AS due
    FROM orders""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    """date_trunc turns a time without zone into one with; going on with its date keeps the result free of zones."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_date(F.date_trunc("month", t)).cast("string").alias("month"), F.month(t).alias("m"), F.dayofyear(t).alias("doy"), F.weekofyear(t).alias("w"), F.dayofweek(t).alias("dow"),
        F.datediff(F.to_date(t), F.lit("1995-01-01").cast("date")).alias("age"), F.date_format(t + F.make_dt_interval(F.lit(1), F.lit(12)), "yyyy-MM-dd HH:mm:ss").alias("due"),
    )


@query("""
    SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, round(power(s_nationkey, 1.5), 6) AS pow, round(cos(radians(s_nationkey)), 6) AS c,
           (s_suppkey // 7)::BIGINT AS whole, (s_suppkey % 7)::BIGINT AS rest, ceil(s_acctbal)::BIGINT AS up, sign(s_acctbal)::INTEGER AS s, greatest(s_nationkey, 12) AS g
    FROM supplier""")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", rounded(F.sqrt(F.abs(b)), "root"), rounded(F.pow(n, F.lit(1.5)), "pow"), rounded(F.cos(F.radians(n)), "c"), F.expr("s_suppkey div 7").alias("whole"),
        (F.col("s_suppkey") % 7).alias("rest"), F.ceil(b).alias("up"), F.signum(b).cast("int").alias("s"), F.greatest(n, F.lit(12)).alias("g"),
    )


@query("""
    SELECT doc_id, length(text)::INTEGER AS n, octet_length(encode(text))::INTEGER AS bytes, substr(text, 3, 12) AS part, md5(text) AS hash,
           len(string_split(text, ' '))::INTEGER AS pieces, len(regexp_extract_all(text, '[aeiou]+'))::INTEGER AS vowels,
           md5(regexp_replace(text, '[^a-zA-Z]+', '_', 'g')) AS slug, md5(lower(text)) AS small, upper(source) AS big, lpad(lang, 4, '*') AS tag, position('the' IN text)::INTEGER AS place,
           reverse(lang) AS back, source || '/' || lang AS path
    FROM documents""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.length(t).alias("n"), F.octet_length(t).alias("bytes"), F.substring(t, 3, 12).alias("part"), F.md5(t).alias("hash"), F.size(F.split(t, " ")).alias("pieces"),
        F.regexp_count(t, F.lit("[aeiou]+")).alias("vowels"), F.md5(F.regexp_replace(t, "[^a-zA-Z]+", "_")).alias("slug"), F.md5(F.lower(t)).alias("small"), F.upper("source").alias("big"), F.lpad("lang", 4, "*").alias("tag"),
        F.locate("the", t).alias("place"), F.reverse("lang").alias("back"), F.concat_ws("/", "source", "lang").alias("path"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.none') AS missing, json_keys(props)[1] AS key FROM events")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    """A path, a declared struct and a variant read the same field."""
    own = F.from_json("props", "k int, none string")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(own["k"], F.try_variant_get(F.parse_json("props"), "$.k", "int")).alias("k"), F.get_json_object("props", "$.none").alias("missing"), F.json_object_keys("props")[0].alias("key")
    )


@query("""
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive,
           list_aggregate(embedding, 'max') AS top, embedding[1:3] AS head
    FROM embeddings""")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """Higher-order functions: no row leaves the JVM and no array is exploded."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(dot, 5).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), F.array_max("embedding").alias("top"), F.slice("embedding", 1, 3).alias("head")
    )


@query("""
    SELECT doc_id, i::INTEGER AS at, w AS word FROM (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))""")
def exploded(spark: SparkSession, d: str) -> DataFrame:
    """The words of each document with their places."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))


@query("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views, count(DISTINCT event_type)::INTEGER AS kinds FROM events GROUP BY user_id""")
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type held in one map for each user."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"), F.size(F.map_keys("m")).alias("kinds"))

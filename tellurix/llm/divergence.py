"""Source divergence audit: how far the words of a source lie from those of each other source of its language, and which
words set it apart from the language as a whole.

The divergence of two sources is a sum over all kept terms of their language, most of which neither has. So it is not
summed: each pair starts at V times the value of a term that both lack, and an inverted index emits what differs from that.
A term that only one of the two has differs by an amount that hangs on its count alone, so such terms are emitted by count;
what a term that both have differs by beyond that comes from its postings. Nothing is emitted where the difference is 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch

#: A term, in UTF-8 after A-Z became a-z: a run of ASCII letters and of all characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of its language that a term must stand in; the unit of shares; ranks of terms that are returned.
LEAST_DOCS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Terms that a task counts before it passes them on.
HELD = 200_000


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed over a task's documents as far as HELD allows."""
    found, held = defaultdict(lambda: (Counter(), Counter())), 0

    def rows() -> Iterator[pa.RecordBatch]:
        parts = []
        for group, (n, docs) in found.items():
            own = [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())]
            names = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in group]
            parts.append(pa.RecordBatch.from_arrays([*names, *own], names=["lang", "source", "term", "n", "docs"]))
        return iter(pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else [])

    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for lang, source, text in zip(b.column("lang"), b.column("source"), texts, strict=True):
            n, docs = found[lang.as_py(), source.as_py()]
            held -= len(n)
            terms = TERM.findall(text.as_py().lower())
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > HELD:
                yield from rows()
                found.clear()
                held = 0
    yield from rows()


def div(a: Column, b: Column) -> Column:
    """Whole division of numbers that are not negative; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def share(count: Column, size: Column, terms: Column) -> Column:
    """A term's smoothed share of a group's occurrences, in billionths and at least 1; null where there are no terms."""
    return 1 + div(UNIT * (count + 1), size + terms)


def apart(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def audit(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """`lang, source, part, item, value, rank`: for each source of a language its divergence from every other one (part
    `pair`), and the RANKS terms that it has more of than the language (part `term`).

    Null texts, languages and sources count as empty ones. Documents are rows: repeated ones count each time, and ids
    play no part. A group without terms is a group all the same; where a language keeps no term, its pairs have the value
    0 and stand in order of their items. Ties stand in order of the items' UTF-8. An empty table gives no rows, and
    columns other than text, lang and source are not looked at. Texts are read as a stream, however long.

    A term's rows number its sources, and so does what a task takes for one term; shares and sums are longs, exact up to
    (1 + UNIT) ** 2 a term, and an overflow would be an error.
    """
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = scratch.table(docs.select("lang", "source").distinct(), "groups")
    # dealt out once for the sums by source and the windows over a term's sources; tasks have added up what is theirs
    counts = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), F.row_number().over(of_term.orderBy("source")).alias("nth"))
    kept = scratch.table(kept.where(F.col("docs") >= LEAST_DOCS).select("lang", "source", "term", "n", "total", (F.col("nth") == 1).alias("first")), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("terms"))
    none = {"size": 0, "lang_size": 0, "terms": 0}
    sizes = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(none)
    sizes = scratch.table(sizes.withColumn("zero", share(F.lit(0), F.col("size"), F.col("terms"))), "sizes")
    postings = kept.join(sizes, ["lang", "source"]).select(
        "lang", "source", "term", "n", "zero", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q")
    )

    part = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= RANKS)

    total = sizes.select("lang", "source", F.col("terms").alias("v"), F.col("zero").alias("p0")).join(sizes.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0")), "lang").where("source <> item")
    start = total.select("lang", "source", "item", F.coalesce(F.col("v") * apart(F.col("p0"), F.col("q0")), F.lit(0).cast("long")).alias("value"))
    every = start.unionByName(alone(postings, sizes)).unionByName(both(postings))
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(part))
    out = scratch.table(pairs.unionByName(own), "result")
    scratch.drop_all_but(out)
    return out


def alone(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """What terms that one source has differ by, the other having none: by source and count, times the terms with it."""
    counts = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("p").alias("p"), F.first("zero").alias("p0"))
    met = counts.join(sizes.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0")), "lang").where("source <> item")
    p, p0, q0, times = (F.col(c) for c in ("p", "p0", "q0", "times"))
    sides = F.array(
        F.struct("source", "item", (times * (apart(p, q0) - apart(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (times * (apart(q0, p) - apart(q0, p0))).alias("value")),
    )
    return met.select("lang", F.inline(sides)).where("value <> 0")


def both(postings: DataFrame) -> DataFrame:
    """What terms that two sources have differ by beyond what `alone` has for either: each two postings of a term meet
    once, for both directions."""
    a = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"), F.col("zero").alias("p0"))
    b = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    beyond = lambda p, p0, q, q0: apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    met = a.join(b, ["lang", "term"]).where("a < b").select("lang", "a", "b", beyond(p, p0, q, q0).alias("ab"), beyond(q, q0, p, p0).alias("ba")).where("ab <> 0 or ba <> 0")
    met = met.groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    return met.select("lang", F.inline(sides))


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
    v AS (SELECT d.lang, count(DISTINCT term) AS v FROM d LEFT JOIN kept USING (lang) GROUP BY d.lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    sl AS (SELECT lang, sum(size)::BIGINT AS size FROM s GROUP BY lang),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.size + v.v) AS p, 1 + 1000000000 * (kept.total + 1) // (sl.size + v.v) AS q
          FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) JOIN s USING (lang, source) JOIN sl USING (lang) JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
          SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""

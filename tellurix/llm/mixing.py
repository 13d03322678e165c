"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of
sizes, and a cut at each source's exact budget, with repeated epochs. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurix.llm.common import WORD, Scratch, n_words

#: Hexadecimal digits of the key that name a coarse and, within it, a fine key range: 256 and 256 * 4,096 of a source.
COARSE, FINE = 2, 3


def targets(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Per source (columns source, source_size) the words to take, as `target`.

    Sources by code point, null last, have the weights in turn. They share `share` times all sizes by weight; a target
    stops at `epochs` times its source's size and the excess is shared again by weight until none is above. That is
    min(cap, level * weight) for one level, found in a single pass over the sources by cap / weight: the first source
    that the level left by those before it does not fill sets the level. `sources` has one row a source, not one a
    document, so the window over all of it is small.
    """
    n = len(weights)
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size").cast("double") * epochs)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    total, all_w = F.sum("source_size").over(everything).cast("double") * share, F.sum("_w").over(everything)
    left = ranked.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (all_w - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    open_ = F.when(F.col("_cap") >= F.col("_w") * F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))
    level = F.min(open_).over(everything)["_level"]
    return left.withColumn("_fill", level).select(
        "source", "source_size", F.coalesce(F.least("_cap", F.col("_w") * F.col("_fill")), "_cap").alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each row of `docs` (doc_id, source, size, and if given `row`, a row's own number, and
    `tie`, which orders rows of one id and size; other columns are dropped).

    Returns doc_id, size, source_size, target, taken and, if given, row. A source with target T and S words is taken floor(T / S) times
    over, and then in the order of the documents' random keys until floor(T) words: the document on the cut gives
    only the words up to it. The key is a hash of the seed and doc_id, so reruns agree whatever the partitions.
    Null sizes count as 0, a null source is a source, rows with one id and size are in any order if nothing else tells
    them apart, and an empty table gives an empty mix. Rows with a null or repeated id are taken each for itself.

    A source is dealt out by key range, not by its name: rows meet in (source, coarse, fine) groups, only sums of
    those meet per (source, coarse), and only sums of these per source, at most 16 ** COARSE of them. So a source that
    holds most rows is no heavier than the others.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    more = [c for c in ("tie", "row") if c in docs.columns]
    rows = docs.select(
        "doc_id", "source", *more, F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
    ).withColumns({"_c": F.substring("_key", 1, COARSE), "_f": F.substring("_key", COARSE + 1, FINE), "_s": F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))})
    rows = scratch.table(rows, "rows")  # the texts are read once, for their sizes
    fine = rows.groupBy("_s", "_c", "_f").agg(F.sum("size").alias("_n"), F.first("source").alias("source"))
    coarse = fine.groupBy("_s", "_c").agg(F.sum("_n").alias("_n"), F.first("source").alias("source"))
    sources = coarse.groupBy("_s").agg(F.sum("_n").alias("source_size"), F.first("source").alias("source"))
    plan = targets(sources.drop("_s"), weights, share, epochs).withColumn("_s", F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))).drop("source")

    def before(*by: str) -> Column:
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = coarse.select("_s", "_c", before("_s", "_c").alias("_coarse")).join(plan, "_s")
    fine = fine.select("_s", "_c", "_f", before("_s", "_c", "_f").alias("_fine")).join(coarse, ["_s", "_c"])
    within = Window.partitionBy("_s", "_c", "_f").orderBy("_key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_row", F.coalesce(F.sum("size").over(within), F.lit(0))).join(fine, ["_s", "_c", "_f"])
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = F.floor("target") - whole * F.col("source_size") - (F.col("_coarse") + F.col("_fine") + F.col("_row"))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[c for c in more if c == "row"])


def apply(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` as `mix`, which gets the arguments `how`, takes them, with their columns: a document once for each
    whole time, and once more cut after its last taken word. n_chars follows a cut text. Rows are numbered in a written
    table, so that null and repeated ids are taken just as the mix decides; documents of which it takes nothing go.
    Only ids and counts meet the texts.
    """
    numbered = Scratch(docs.sparkSession, "mixed").table(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "numbered")
    sized = numbered.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5("text").alias("tie"), F.col("__mix_row").alias("row"))
    takes = mix(sized, **how).where("taken > 0").select(F.col("row").alias("__mix_row"), F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    whole, rest = F.expr("__mix_taken div __mix_size"), F.expr("__mix_taken % __mix_size")
    pieces = F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))
    out = numbered.join(takes, "__mix_row").withColumns({"__mix_whole": whole, "__mix_rest": rest}).withColumn("__mix_piece", F.explode(pieces))
    # split() with a limit leaves all that follows the last wanted word in the last element
    skipped = F.when(F.regexp_like("text", F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    tail = F.element_at(F.split("text", r"[\x20\x09-\x0D]+", (F.col("__mix_rest") + 1 + skipped).cast("int")), -1)
    cut = F.when(F.col("__mix_piece") > F.col("__mix_whole"), F.expr("rtrim(substring(text, 1, length(text) - length(__mix_tail)))")).otherwise(F.col("text"))
    out = out.withColumn("__mix_tail", F.when(F.col("__mix_piece") > F.col("__mix_whole"), tail)).withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(r % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE cap >= w * level ORDER BY cap / w, r LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM f)), cap) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM p
"""

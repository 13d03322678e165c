"""Quality rules: statistics of each text, and the frequency of its lines over the documents of its host."""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import MEMO, WORD, Scratch, per_batch, record_batch, row_key

#: A line is frequent above this number of documents of its host and above this share of them.
MAX_DOCS, MAX_SHARE = 5, 0.01
#: A document is depleted when less than this share of its words, or fewer words than this, are outside frequent lines.
MIN_LEFT, LEAST_WORDS = 0.3, 50
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"

SCHEMA = (
    "doc_id long, host string, row_key string, word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_hash array<long>, line_words array<int>"
)


class Numbers(dict):
    """Numbers words as they come."""

    def __init__(self):
        super().__init__()
        self.next = count().__next__

    def __missing__(self, word):
        self[word] = n = self.next()
        return n


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(numbers) < 4:
        return 0
    if numbers.max() < 1 << 20:
        keys = numbers[:-2] << 40 | numbers[1:-1] << 20 | numbers[2:]
    else:  # a text of very many distinct words: number the pairs first
        pairs = np.unique(numbers[:-1] << 32 | numbers[1:], return_inverse=True)[1]
        keys = pairs[:-1] << 32 | numbers[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again, covered = np.isin(keys, twice), np.zeros(len(numbers), bool)
    for j in range(3):
        covered[j : len(numbers) - 2 + j] |= again
    return int(covered.sum())


def hash60(b: bytes) -> int:
    return int(hashlib.md5(b).hexdigest()[:15], 16)


def text_statistics(batch: pa.RecordBatch, memo=[Numbers()]) -> pa.RecordBatch:  # noqa: B006  kept between batches
    out = {k: [] for k in ("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words")}
    for text in batch.column("text").to_pylist():
        raw = (text or "").encode()
        words = raw.split()
        if len(memo[0]) > MEMO:
            memo[0] = Numbers()
        numbers = np.fromiter(map(memo[0].__getitem__, words), np.int64, len(words))
        seen, dup, lines = set(), 0, {}
        for line in raw.split(b"\n"):
            own = line.lower().split()
            if own:
                dup += line in seen
                seen.add(line)
                norm = b" ".join(own)
                lines[norm] = lines.get(norm, 0) + len(own)
        hashes = [hash60(x) for x in lines]
        out["word_chars"].append(len(text or "") - (len(raw) - len(raw.translate(None, SPACE))))
        out["n_words"].append(len(words))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(dup)
        out["n_repeat_words"].append(repeated_words(numbers))
        out["line_hash"].append(hashes)
        out["line_words"].append(list(lines.values()))
    types = {"line_hash": pa.list_(pa.int64()), "line_words": pa.list_(pa.int32())}
    own = {k: (v, types.get(k, pa.int64())) for k, v in out.items()}
    return record_batch({"doc_id": (batch.column("doc_id"), pa.int64()), "host": (batch.column("host"), pa.string()), "row_key": (batch.column("row_key"), pa.string())} | own)


def rules(docs: DataFrame, spark: SparkSession, host: str = "source", first_stays: bool = False) -> DataFrame:
    """A verdict for each row of `docs` (doc_id, text and the host column; other columns are dropped).

    Lines are lower-cased in A-Z, their white space made single blanks, and hashed. For each host and line, distinct
    documents are counted, exact copies once. A line above MAX_DOCS documents and MAX_SHARE of its host's is removed.
    A document that keeps less than MIN_LEFT of its words, or fewer than LEAST_WORDS, is depleted.

    With `first_stays` a frequent line stays in one text of its host: the first, in the order of a hash of host and text, of
    those that pass the base rules. So a group of copies or near copies, whose lines are all frequent, is not rejected
    as a whole: the first text keeps its lines, and the others go.

    Returns doc_id, the statistics, base_failed, kept, removed_words, removed (hashes of its removed lines) and row_key, by
    which `cleaned` finds a row's verdict. A null or empty text, however many, has no words and so fails the base
    rules; null hosts are one host; repeated rows are judged each, and alike; very long texts are judged whole; an
    empty table gives an empty one; other columns may have any name.

    A line that a third of all documents hold is summed before each shuffle, and the join of documents' lines with
    the frequent ones, unique on the host and line, is one whose large partitions Spark splits.
    """
    scratch = Scratch(spark, "quality")
    own = docs.select("doc_id", F.col(host).alias("host"), row_key(host, "text").alias("row_key"), "text")
    stats = scratch.table(per_batch(own, text_statistics, SCHEMA).withColumn("_row", F.monotonically_increasing_id()), "stats")
    host_key = F.concat(F.col("host").isNull().cast("string"), F.coalesce("host", F.lit("")))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    place = F.when(~base_failed, F.xxhash64("row_key")) if first_stays else F.lit(None).cast("long")
    lines = stats.select("_row", host_key.alias("_host"), "row_key", place.alias("place"), F.inline(F.arrays_zip("line_hash", "line_words")))
    hosts = stats.groupBy(host_key.alias("_host"), "row_key").agg(F.lit(1).alias("x")).groupBy("_host").agg(F.count("*").alias("_docs"))
    counted = lines.groupBy("_host", "line_hash", "row_key").agg(F.min("place").alias("place")).groupBy("_host", "line_hash").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    elsewhere = ~F.col("place").eqNullSafe(F.col("first")) | F.col("first").isNull()
    frequent = counted.where(F.col("n") > MAX_DOCS).join(hosts, "_host").where(F.col("n") > MAX_SHARE * F.col("_docs"))
    gone = lines.join(frequent.select("_host", "line_hash", "first"), ["_host", "line_hash"]).where(elsewhere).groupBy("_row").agg(F.sum("line_words").alias("removed_words"), F.array_sort(F.collect_list("line_hash")).alias("removed"))
    out = stats.drop("line_hash", "line_words").join(gone, "_row", "left").withColumns(
        {"base_failed": base_failed, "removed_words": F.coalesce("removed_words", F.lit(0)), "removed": F.coalesce("removed", F.array().cast("array<bigint>"))}
    )
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (left >= MIN_LEFT * F.col("n_words")) & (left >= LEAST_WORDS)
    out = scratch.table(
        out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed_words", "removed", "row_key"), "verdicts"
    )
    scratch.drop(stats)
    return out


def cleaned(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """The rows of `docs` that `rules` keeps, without the lines that it removes; other lines, and texts without such lines,
    stay as they are, and n_chars follows. Rows meet their verdict by their host and text, so rows with null or
    repeated ids have their own. Texts are dealt out by that digest, whatever the size; a text that a third of all
    rows repeat is one row on the other side, and Spark splits such a join."""
    norm = lambda x: F.trim(F.regexp_replace(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    own = lambda x: F.conv(F.substring(F.md5(norm(x)), 1, 15), 16, 10).cast("long")
    touched = verdicts.where("not kept or removed_words > 0").groupBy(F.col("row_key").alias("__quality_key")).agg(F.first("kept").alias("__quality_kept"), F.first("removed").alias("__quality_removed"))
    out = docs.hint("merge").join(touched, row_key(host, "text") == F.col("__quality_key"), "left").where(F.coalesce("__quality_kept", F.lit(True)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__quality_removed", own(x))), "\n")
    some = F.col("__quality_key").isNotNull()
    changed = {"text": F.when(some, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def op3(docs: DataFrame, spark: SparkSession) -> DataFrame:
    return rules(docs, spark).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM t, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
l AS (
  SELECT r, source, h, line, trim(regexp_replace({AZ.format("line")}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '{WORD}')) AS n
  FROM (SELECT r, source, h, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM l WHERE n > 0 GROUP BY r, line) GROUP BY r),
k AS (SELECT r, source, h, md5(norm)[:15] AS lh, sum(n) AS n FROM l WHERE n > 0 GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT h) AS n FROM d GROUP BY source),
c AS (SELECT source, lh, count(DISTINCT h) AS n FROM k GROUP BY source, lh),
f AS (SELECT c.source, lh FROM c JOIN hosts ON c.source IS NOT DISTINCT FROM hosts.source WHERE c.n > {MAX_DOCS} AND c.n > {MAX_SHARE} * hosts.n),
gone AS (SELECT r, sum(n) AS n FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.lh = f.lh GROUP BY r),
s AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN gone ON d.r = gone.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - gone >= {MIN_LEFT} * n_words AND n_words - gone >= {LEAST_WORDS} AS kept
FROM b
"""

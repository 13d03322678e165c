"""A corpus made ready for training: quality rules, near-duplicates, secrets, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the columns
of `documents`. Rows are told apart by their values, so that those with null or repeated ids have their own verdict; rows
alike in id and text go or stay together. Null texts fail the quality rules; any table, an empty one too, goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm import bpe, mixing, neardup, quality, secrets
from tellurix.llm.common import Scratch, row_key, table
from tellurix.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that are frequent on their host, but for the first
    text with a line, which keeps it: of near copies, whose lines are all frequent, one is left."""
    return quality.cleaned(docs, quality.rules(docs, spark, first_stays=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, and all rows with a null id do. Rows are
    dealt out by id and text, whatever the size: the rejected grow with the input, and are not for sending to all tasks."""
    gone = neardup.near_duplicates(docs, spark).where("not kept").select(F.col("row_key").alias("__gone"))
    return docs.hint("merge").join(gone, row_key("doc_id", "text") == F.col("__gone"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, the one on the cut up to its last taken word."""
    return mixing.apply(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids of each document, and digests of them and of what they decode to."""
    return bpe.encode(docs, spark, WORD_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: SQL cannot express the encoding, nor components of near-duplicates; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's rows written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), "stage")
        if id(before) in scratch.paths:
            scratch.drop(before)
    return docs

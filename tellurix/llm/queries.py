"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tellurix.llm import bpe, bytebpe, chat, codes, divergence, embeddings, html, licenses, mixing, neardup, quality, secrets, warc
from tellurix.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(table(spark, sf_dir, "pages"), spark)


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(table(spark, sf_dir, "conversations"), spark)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(table(spark, sf_dir, "documents"), spark)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), spark)


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), spark).drop("row_key")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8(table(spark, sf_dir, "documents"))


def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), spark, WORD_BPE)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), spark)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), spark)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op11(table(spark, sf_dir, "embeddings"), spark)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), spark)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which itself imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_index_merge,
        op2_tool_call_linking,
        op3_quality_rules,
        op4_mixing,
        op5_bpe_chunk_reuse,
        op6_license_scan,
        op7_minhash_neardup,
        op8_secret_scan,
        op9_embedding_neardup,
        op10_html_extraction,
        op11_vector_codes,
        op12_source_divergence,
        op13_byte_bpe,
        pipeline,
    )
}
ORACLE_SQL = {
    "op1_warc_index_merge": warc.SQL,
    "op2_tool_call_linking": chat.SQL,
    "op3_quality_rules": quality.SQL,
    "op4_mixing": mixing.SQL,
    "op7_minhash_neardup": neardup.SQL,
    "op9_embedding_neardup": embeddings.SQL,
    "op11_vector_codes": codes.SQL,
    "op12_source_divergence": divergence.SQL,
}

"""Queries of the training-data operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat, counts, decontam, ngram_join, pii, quality, ring, simhash, toxicity
from quillon.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_read(spark, sf_dir, "conversations"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(simhash.fingerprints(_read(spark, sf_dir, "documents")))


_OP9_SQL = """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM (SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM conversations
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
GROUP BY conv_id
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_personal_data, op3_sharding, op4_token_counts, op5_decontamination, op6_quality, op7_ngram_join, op8_toxicity, op9_chat_format, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": _OP9_SQL}

"""A training corpus from ``documents``: filtered, freed of near copies and test items, masked, encoded.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.

Rows are judged by their texts. Null, empty and blank texts go with the first stage; the later ones, given any, leave
them as they are, the last with null or no tokens. A null id is an id. Texts of any length are looked at whole.
Repeated rows are alike to every stage but the second, which leaves one. Empty tables give empty results, and other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontam, ngram_join, pii, quality
from quillon.llm._frames import cut
from quillon.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble keeps; it is fitted on the labelled ones among them, without labels it keeps all with words. Ties at the threshold stay."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id; of several texts of that id the one of the least n-gram set by hash."""
    return ngram_join.drop_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets masked; ``n_chars`` follows."""
    return pii.mask(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, round_trip`` of all documents, repeated rows too; null in all but the id for a null text."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontaminate),
    ("personal_data", _mask),
    ("encoding", _encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut from the lineage of the next."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: A classifier that is trained, loopy inference and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None

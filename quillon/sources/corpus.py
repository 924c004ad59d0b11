"""A corpus with its document frequencies, kept as tables so that scores of later texts use the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import tokens


def save_corpus(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists") -> None:
    """Write ``documents`` (``doc_id, text``) and ``frequencies`` (``word, df``) below a folder."""
    df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").write.mode(mode).parquet(f"{path}/documents")
    kept = df.sparkSession.read.parquet(f"{path}/documents")
    tokens.document_frequency(kept).write.mode(mode).parquet(f"{path}/frequencies")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents and the frequencies of a saved corpus; ids are the first column of the former."""
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/frequencies")

"""Dictionaries as wide CSV files, one column a dimension, and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, path: str, missing: tuple[str, ...] = ("",)) -> DataFrame:
    """``dimension, word, rank INT`` of a CSV with a header; cells among ``missing`` are left out. Ranks follow the rows of one file."""
    wide = spark.read.csv(path, header=True, multiLine=True)
    at = wide.select("*", F.monotonically_increasing_id().alias("_at"))
    long = at.unpivot("_at", wide.columns, "dimension", "word").where(F.col("word").isNotNull() & ~F.col("word").isin(*missing))
    order = Window.partitionBy("dimension").orderBy("_at")
    return long.select("dimension", "word", (F.row_number().over(order) - 1).alias("rank"))


def widen(dictionary: DataFrame) -> DataFrame:
    """``rank`` and a column for each dimension by name, filled with nulls below."""
    dims = [r[0] for r in dictionary.select("dimension").distinct().orderBy("dimension").collect()]
    return dictionary.groupBy("rank").pivot("dimension", dims).agg(F.first("word"))


def write_wide(dictionary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file in order of rank: a dictionary is small, and its rows must stay in order."""
    widen(dictionary).coalesce(1).sortWithinPartitions("rank").drop("rank").write.mode(mode).csv(path, header=True)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: the distinct words of a text file, case as it is."""
    return spark.read.text(path).select(F.explode(F.split("value", " ")).alias("word")).select(F.trim("word").alias("word")).where("word <> ''").distinct()


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """``dimension, word``: positive and negative words, in lower case, of a CSV ``Word, Positive, Negative`` (above 0: yes)."""
    df = spark.read.csv(path, header=True)
    part = lambda name: df.where(F.col(name).cast("double") > 0).select(F.lit(name.lower()).alias("dimension"), F.lower("Word").alias("word"))
    return part("Positive").unionByName(part("Negative")).distinct()


def read_weighted_pairs(spark: SparkSession, path: str, ngram_col: str = "bigram", weight_col: str = "politicaltbb") -> DataFrame:
    """``bigram, tfidf`` of a CSV whose pairs are joined by ``_``."""
    return spark.read.csv(path, header=True).select(F.regexp_replace(ngram_col, "_", " ").alias("bigram"), F.col(weight_col).cast("double").alias("tfidf"))

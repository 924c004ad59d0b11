"""Tables of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of a file or a folder. Where it has fewer splits than there are cores, so that some would be idle, its few rows are spread over all."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)

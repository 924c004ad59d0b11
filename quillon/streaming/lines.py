"""Line files as a resumable stream: each run takes up what the last one left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def process_lines(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Transform, restart: bool = False, timeout: int | None = None) -> None:
    """Apply a row-wise transform to new files of lines and append the results as Parquet.

    The checkpoint remembers what has been read, so an interrupted run goes on where it was, and one without new
    files does nothing. ``restart`` forgets the checkpoint and the results first.
    """
    if restart:
        fs = spark._jvm.org.apache.hadoop.fs
        for p in (target, checkpoint):
            at = fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    lines = spark.readStream.format("text").load(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    run = transform(lines).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(timeout)


def process_table(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Transform) -> None:
    """The same for a folder of Parquet files that grows."""
    schema = spark.read.parquet(source).schema
    run = transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()

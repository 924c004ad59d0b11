"""Frames without their lineage: tables in the folder that the cluster names."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a temporary one serves a local session, as in tests; on a cluster that is an error, for executors couldn't read it."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if sc.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "quillon-checkpoints")


#: Folders of written tables by application; they go with the session's driver.
_WRITTEN: dict[str, tuple[SparkSession, str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _WRITTEN.values():
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before: nothing can be done from here
            pass


class Cut:
    """A frame without its lineage: a Parquet table in the shared folder, which any executor can read again."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        app = self.spark.sparkContext.applicationId
        if app not in _WRITTEN:
            _WRITTEN[app] = (self.spark, f"{shared_folder(self.spark)}/quillon-{app}-{uuid.uuid4().hex[:8]}")
        self.path = f"{_WRITTEN[app][1]}/{uuid.uuid4().hex}"
        flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])  # Parquet refuses names that differ in case only
        flat.write.parquet(self.path)
        self.df = self.spark.read.schema(flat.schema).parquet(self.path).toDF(*df.columns)

    def drop(self) -> None:
        """Delete the table; nothing may read it any more."""
        _remove(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    """The frame, written and read again. Its files go when the driver ends; ``Cut`` can drop them before."""
    return Cut(df).df


def small(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether the frame's rows, as the driver would hold them, take at most ``limit`` bytes: counted, not assumed.

    Counting stops at a number of rows that no row can be small enough for.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    nested = (T.ArrayType, T.MapType, T.StructType)
    width = 16 + 8 * len(df.columns)
    as_text = lambda f: F.to_json(F.struct(f.name)) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")
    size = sum((F.coalesce(F.length(as_text(f)), F.lit(0)) for f in df.schema if not isinstance(f.dataType, fixed)), F.lit(width))
    total = df.limit(limit // width + 1).agg(F.sum(size.cast("long"))).first()[0]
    return (total or 0) <= limit

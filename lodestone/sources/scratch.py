"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # by application: Spark doesn't let a running session name the folder


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="lodestone-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame) -> DataFrame:
    """df written as a table and read back: computed once, lineage ends there, and a lost executor loses none of it. The
    table goes when the driver ends, if it isn't dropped before."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what kept() wrote, once nothing reads it any more."""
    for df in tables:
        if hasattr(df, "kept_path"):
            _files(df.sparkSession, df.kept_path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path), True)

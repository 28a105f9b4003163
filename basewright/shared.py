"""The folder that driver and executors share, and tables written there between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine where that is unset and Spark runs inside this machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "path" not in _OWN:
        _OWN["path"] = tempfile.mkdtemp(prefix="basewright-")
    return _OWN["path"]


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as objects of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the file system deletes it when the session ends."""
    path = f"{work_folder(spark)}/basewright/{label}-{uuid.uuid4().hex}"
    target, files = hadoop_path(spark, path)
    files.deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._bw_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    target, files = hadoop_path(df.sparkSession, df._bw_path)
    files.delete(target, True)

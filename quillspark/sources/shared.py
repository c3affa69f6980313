"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where it is unset and there is one machine) a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: cuts the lineage, and what it holds survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems hold it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_kept(*frames: DataFrame) -> None:
    """Delete the files of tables that keep() wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            drop_path(df.sparkSession, path)

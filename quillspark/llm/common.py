"""Shared folder, written tables and small helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.shared import drop_kept, drop_path, keep, shared_dir
from quillspark.sources.tables import table

__all__ = ["drop_kept", "drop_path", "keep", "shared_dir", "small_batches", "spare", "table"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows and bytes in an Arrow batch, so that long texts don't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")


def spare(df: DataFrame, name: str) -> str:
    """`name`, or the first longer form of it that is no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

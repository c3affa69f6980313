"""Where tables come from and go to: Parquet folders, the catalog, and backups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | list | None = None) -> DataFrame:
    """Run `text`, in which {name} stands for a table of `sf_dir`; parameters go by :name, or by ? if `args` is a list."""
    frames = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, args=args, **frames)


def run_script(spark: SparkSession, sf_dir: str, script: str) -> list[DataFrame]:
    """The results of a script's statements, which end in a semicolon at the end of a line; lines that begin with -- or // don't count.
    CREATE INDEX and DROP INDEX do nothing, as there are no indexes: their result is empty."""
    lines = [x for x in script.splitlines() if not x.lstrip().startswith(("--", "//"))]
    statements = [s for s in re.split(r";[ \t]*(?:\n|$)", "\n".join(lines)) if s.strip()]
    index = re.compile(r"\s*(?:CREATE\s+(?:UNIQUE\s+)?|DROP\s+)INDEX\s", re.I).match
    return [spark.createDataFrame([], "result string") if index(s) else sql(spark, sf_dir, s) for s in statements]


def as_text(df: DataFrame, order: list[str]) -> DataFrame:
    """n, line: `df` as lines of one width, with a heading and a rule first, rows in the given order, NULL for null; n counts from 0.
    Widths are one row of aggregates, and lines are numbered by range, so no task holds all of them."""
    from quillspark.operators.relational import numbered

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))
    found = df.agg(*(F.max(F.length(text(c))).alias(c) for c in df.columns)).first()
    wide = {c: max(len(c), found[c] or 0) for c in df.columns}
    head = df.sparkSession.createDataFrame([(0, " | ".join(c.ljust(w) for c, w in wide.items())), (1, "-+-".join("-" * w for w in wide.values()))], "n long, line string")
    lines = numbered(df, order, "n", start=2).select("n", F.concat_ws(" | ", *(F.rpad(text(c), w, " ") for c, w in wide.items())).alias("line"))
    return head.union(lines)


def system_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """One row for each column of the named tables: table_name, position, column_name, data_type, nullable. Reads schemas only."""
    rows = [
        (n, i, f.name, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(table(spark, sf_dir, n).schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def backup(df: DataFrame, path: str, company: int | None = None, column: str = "CompId") -> None:
    """Write a table as Parquet, all of it or one company's rows."""
    (df if company is None else df.filter(F.col(column) == company)).write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str, into: DataFrame | None = None) -> DataFrame:
    """Read a backup, with the column order and types of `into` if that is given (columns it lacks are null, others are dropped)."""
    df = spark.read.parquet(path)
    if into is None:
        return df
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in into.schema.fields))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, else as it is: joins then fall back to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

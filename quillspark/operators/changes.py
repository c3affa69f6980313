"""INSERT, UPDATE and DELETE as plans over a table's old rows: each returns the new table, which the caller writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_values(df: DataFrame, rows: list[tuple], columns: list[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """`df` and literal rows; columns that aren't named get their default or null, and values are cast to the column's type."""
    columns = columns or df.columns
    more = df.sparkSession.createDataFrame([], df.schema).select(*columns) if not rows else None
    if more is None:
        fields = [df.schema[c] for c in columns]
        more = df.sparkSession.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{f.name}` {_literal_type(f, i, rows)}" for i, f in enumerate(fields)))
    return insert_select(df, more, columns, defaults)


def _literal_type(field, i: int, rows: list[tuple]) -> str:
    kind = field.dataType.simpleString()
    kinds = {type(r[i]) for r in rows if r[i] is not None}
    return "string" if kinds == {str} else "double" if kinds <= {int, float} and float in kinds else "bigint" if kinds == {int} else kind


def insert_select(df: DataFrame, rows: DataFrame, columns: list[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """`df` and the rows of a query, by position of `columns`."""
    columns, defaults = columns or df.columns, defaults or {}
    rows = rows.toDF(*columns)
    return df.union(rows.select(*((F.col(f.name) if f.name in columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema.fields)))


def insert_set(df: DataFrame, **values: object) -> DataFrame:
    """`df` and one row given by column names."""
    return insert_values(df, [tuple(values.values())], list(values))


def _chosen(df: DataFrame, where: Column, limit: int | None, key: list[str], order: list[str]) -> DataFrame:
    """Keys of the first `limit` rows that match, by `order` and then `key` (unique): a top-k of each partition, then of those."""
    return df.filter(where).orderBy(*order, *key).limit(limit).select(*(F.col(k).alias(f"_{k}") for k in key)).withColumn("_hit", F.lit(True))


def _marked(df: DataFrame, where: Column, limit: int, key: list[str], order: list[str]) -> DataFrame:
    hits = _chosen(df, where, limit, key, order)
    on = F.lit(True)
    for k in key:
        on = on & df[k].eqNullSafe(hits[f"_{k}"])
    return df.join(hits, on, "left")


def update(df: DataFrame, where: Column, values: dict[str, Column], limit: int | None = None, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """`df` with new values in the rows for which `where` is true; with `limit`, in the first of them by `order` and the unique `key`.
    Every new value sees the row's old ones."""
    if limit is None:
        hit, rows = F.coalesce(where, F.lit(False)), df
    else:
        rows = _marked(df, where, limit, key, order or [])
        hit = F.col("_hit").isNotNull()
    kind = {f.name: f.dataType for f in df.schema.fields}
    return rows.select(*(F.when(hit, values[c].cast(kind[c])).otherwise(rows[c]).alias(c) if c in values else rows[c] for c in df.columns))


def delete(df: DataFrame, where: Column, limit: int | None = None, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """`df` without the rows for which `where` is true; with `limit`, without the first of them by `order` and the unique `key`."""
    if limit is None:
        return df.filter(~F.coalesce(where, F.lit(False)))
    rows = _marked(df, where, limit, key, order or [])
    return rows.filter("_hit IS NULL").select(*(rows[c] for c in df.columns))

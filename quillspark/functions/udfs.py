"""User-defined functions: scalar ones in Arrow batches, and aggregates that are folded in two steps."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, scalar: dict[str, tuple[Callable, str]]) -> None:
    """Make functions of pandas Series callable from SQL: name -> (function, return type)."""
    for name, (f, kind) in scalar.items():
        spark.udf.register(name, F.pandas_udf(f, kind))


def fold(df: DataFrame, keys: list[str], column: str, zero: object, step: Callable, merge: Callable, finish: Callable, kind: str, alias: str) -> DataFrame:
    """A user-defined aggregate: `step(acc, value)` folds the rows of a key within each task, `merge(acc, acc)` joins the tasks' results,
    and `finish(acc)` gives the value, of type `kind`. No task sees more of a key than its own rows or one value from each task."""
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for batch in batches:
            for *key, value in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                k = tuple(key)
                held[k] = step(held.get(k, zero), value)
        if held:
            yield pd.DataFrame([(*k, pickle.dumps(v)) for k, v in held.items()], columns=[*keys, "acc"])

    def across(found: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(x) for x in found["acc"]]
        acc = parts[0]
        for x in parts[1:]:
            acc = merge(acc, x)
        return pd.DataFrame([(*found.iloc[0][keys], finish(acc))], columns=[*keys, alias])

    partial = df.select(*keys, column).mapInPandas(within, f"{key_types}, acc binary")
    return partial.groupBy(*keys).applyInPandas(across, f"{key_types}, `{alias}` {kind}")

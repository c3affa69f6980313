"""Relational operators that Spark lacks by that name: quantified subqueries, null-matching joins, groups with one chosen row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.semantics import ANSI, NATIVE
from quillspark.sources.shared import keep


def join_null_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys match each other; still a hash or sort-merge join."""
    on = None
    for a, b in keys:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return left.join(right, on, how)


def outer_join_prefiltered(left: DataFrame, right: DataFrame, on: Column, left_where: Column | None = None, right_where: Column | None = None, how: str = "left") -> DataFrame:
    """An outer join whose conditions on one table filter that table before the join, on the null-supplying side too."""
    left = left if left_where is None else left.filter(left_where)
    right = right if right_where is None else right.filter(right_where)
    return left.join(right, on, how)


def quantified(df: DataFrame, x: str, op: str, quantifier: str, values: DataFrame, column: str, native: bool = False) -> DataFrame:
    """Rows of `df` for which x op ANY | ALL (SELECT column FROM values) is true.

    = ANY is a semi-join and <> ALL an anti-join; the others compare with one row of aggregates of `values` (a broadcast of exactly one
    row), so neither side is collected or looped over. ANSI: over no values ANY is false and ALL true, and a null among the values can
    make ALL unknown. `native`: null is the lowest value and matches null, and over no values both are false.
    """
    quantifier = quantifier.upper()
    s = values.select(F.col(column).alias("_v"))
    if (op, quantifier) == ("=", "ANY"):
        return df.join(s, df[x].eqNullSafe(s["_v"]) if native else df[x] == s["_v"], "left_semi")
    some = s.agg(
        F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
    )
    c, compare = F.col, (NATIVE if native else ANSI)[op]
    if native:  # null counts among the values, as the lowest
        some = some.withColumn("_low", F.when(c("_m") == c("_n"), c("_low")))
    if (op, quantifier) == ("<>", "ALL"):
        own = df.join(s.filter("_v IS NOT NULL") if not native else s, df[x].eqNullSafe(s["_v"]), "left_anti")
        own = own.crossJoin(F.broadcast(some))
        keep = (c("_n") > 0) if native else (c("_n") == 0) | (c(x).isNotNull() & (c("_n") == c("_m")))
        return own.filter(keep).select(*(own[f] for f in df.columns))
    own = df.crossJoin(F.broadcast(some))
    value = c(x)
    if quantifier == "ANY":
        if op == "<>":
            keep = NATIVE["<>"](c("_low"), c("_high")) | compare(value, c("_low")) if native else (c("_low") != c("_high")) & value.isNotNull() | compare(value, c("_low"))
        else:
            keep = compare(value, c("_low") if op in (">", ">=") else c("_high"))
        keep = keep & (c("_n") > 0)
    else:
        if op == "=":
            keep = compare(value, c("_low")) & compare(value, c("_high"))
        else:
            keep = compare(value, c("_high") if op in (">", ">=") else c("_low"))
        keep = keep & (c("_n") > 0) if native else (c("_n") == 0) | (keep & (c("_n") == c("_m")))
    return own.filter(keep).select(*df.columns)


def group_max(df: DataFrame, keys: list[str], largest: str, then: list[str]) -> DataFrame:
    """The row of each group in which `largest` is largest (null lowest); of ties, the one with the smallest `then` columns.

    Two aggregations with partial results over one scan, the first by the keys and `largest`; no sort of a group.
    """
    top, row = "_top", F.struct(*df.columns)
    ties = df.groupBy(*keys, F.col(largest).alias(top)).agg(F.min_by(row, F.struct(*then)).alias("_row"))
    return ties.groupBy(*keys).agg(F.max_by("_row", F.struct(F.col(top).isNotNull(), F.col(top))).alias("_row")).select("_row.*")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each group that comes first by `order`: how columns that are not grouped get a value that doesn't depend on chance."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def avg_native(c: Column) -> Column:
    """The sum over all rows of the group, those with null too, to ten decimals."""
    return F.round(F.sum(c) / F.count(F.lit(1)), 10)


def min_native(c: Column) -> Column:
    """Null if any value is null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))


def sum_native(c: Column, order: Column) -> Column:
    """Null if the first value by `order` is null, else the sum of the others."""
    return F.when(F.min_by(c.isNotNull(), order), F.sum(c))


def count_distinct_native(*cs: Column) -> Column:
    """Counts combinations, nulls included."""
    return F.count_distinct(F.struct(*cs))


def page(df: DataFrame, order: list[Column | str], offset: int, rows: int) -> DataFrame:
    """`rows` rows from the `offset`-th on in the given order."""
    return df.orderBy(*order).offset(offset).limit(rows)


def orderable(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns, or an error for types that have no order."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind == "binary" or kind.startswith(("map", "variant")):
            raise ValueError(f"cannot sort by {c}: {kind}")
    return columns


def zip_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Columns of both, the n-th row of one beside the n-th of the other by their own orders; the shorter one ends both.

    Numbers come from ranges: rows are range-partitioned and counted by partition, so that no task holds a whole table.
    """
    return numbered(left, left_order, "_nth").join(numbered(right, right_order, "_nth"), "_nth").drop("_nth")


def numbered(df: DataFrame, order: list[str], name: str = "nth", start: int = 1) -> DataFrame:
    """`df` with consecutive numbers in the given order: rows are range-partitioned and sorted, and a partition's numbers go on from the
    sizes of those before. The sorted rows are written to the shared folder, as a range partitioning that is made again may cut elsewhere."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "numbered")
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))  # one row for each partition
    before = sizes.select("_p", "_first", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") - F.col("_first") + F.coalesce("_before", F.lit(0)) + start).drop("_p", "_i", "_first", "_before")


def end_value(column: str, order: str, last: bool = False) -> Column:
    """The column's value in the first or last row by `order`."""
    return (F.max_by if last else F.min_by)(F.col(column), F.col(order))


def single_value(column: str) -> Column:
    """The column's value if all rows have the same one, else null."""
    return F.when((F.min(column) == F.max(column)) & (F.count(column) == F.count(F.lit(1))), F.min(column))


def rest(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows but the first by `order`."""
    return numbered(df, order, "_rest").filter("_rest > 1").drop("_rest")

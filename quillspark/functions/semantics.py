"""The opt-in dialect in which null is the lowest value and comparisons are never null, and arithmetic that never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def lt(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def le(a: Column, b: Column) -> Column:
    return a.isNull() | F.coalesce(a <= b, F.lit(False))


def gt(a: Column, b: Column) -> Column:
    return lt(b, a)


def ge(a: Column, b: Column) -> Column:
    return le(b, a)


def between(x: Column, low: Column, high: Column) -> Column:
    return ge(x, low) & le(x, high)


def not_between(x: Column, low: Column, high: Column) -> Column:
    return lt(x, low) | gt(x, high)


def in_list(x: Column, *values: Column) -> Column:
    """x = ANY of the list; a null matches a null."""
    out = F.lit(False)
    for v in values:
        out = out | eq(x, v)
    return out


#: Comparisons by name, in the null-lowest dialect and in ANSI.
NATIVE = {"=": eq, "<>": ne, "<": lt, "<=": le, ">": gt, ">=": ge}
ANSI = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def any_of(x: Column, op: str, *values: Column, native: bool = False) -> Column:
    """x op ANY (values)."""
    out = F.lit(False)
    for v in values:
        out = out | (NATIVE if native else ANSI)[op](x, v)
    return out


def all_of(x: Column, op: str, *values: Column, native: bool = False) -> Column:
    """x op ALL (values)."""
    out = F.lit(True)
    for v in values:
        out = out & (NATIVE if native else ANSI)[op](x, v)
    return out


def div10(a: Column, b: Column) -> Column:
    """a / b, half up to ten decimals; null where b is zero."""
    return F.round(F.try_divide(a, b), 10)


def regex_full(x: Column, pattern: str, flags: str = "") -> Column:
    """Whether all of x matches the pattern, a last line break included; flags of i, s and m."""
    return x.rlike(rf"\A(?:{f'(?{flags})' if flags else ''}{pattern})\z")


def like(x: Column, pattern: str) -> Column:
    """LIKE with % _ and the escape \\, over the text of any value; null stays null."""
    return x.cast("string").like(pattern)

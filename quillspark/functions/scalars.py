"""Scalar functions whose meaning differs from Spark's function of that name, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring0(s: Column, begin: Column | int, end: Column | int | None = None) -> Column:
    """From character `begin` (counted from 0) up to, not including, `end`; both are cut to the text, and an empty range gives ''."""
    size = F.length(s)
    b = F.greatest(F.lit(begin) if isinstance(begin, int) else begin, F.lit(0))
    e = size if end is None else F.least(F.lit(end) if isinstance(end, int) else end, size)
    return F.when((b >= size) | (e <= b), F.when(s.isNotNull(), "")).otherwise(F.substring(s, b + 1, e - b))


def trim_text(s: Column, strip: str = " ", side: str = "both") -> Column:
    """Strips repeats of a whole string (not of its characters) from one side or both."""
    p = f"(?:{re.escape(strip)})+"
    if side in ("both", "leading"):
        s = F.regexp_replace(s, rf"\A{p}", "")
    return F.regexp_replace(s, rf"{p}\z", "") if side in ("both", "trailing") else s


def to_number(x: Column, kind: str = "string") -> Column:
    """Text that is no number counts as 0, booleans as 1 and 0, dates and timestamps as milliseconds since 1970."""
    if kind == "boolean":
        return x.cast("int").cast("double")
    if kind in ("date", "timestamp"):
        return F.unix_millis(x.cast("timestamp")).cast("double")
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.lit(0.0)))


def if_native(condition: Column, then: Column, other: Column) -> Column:
    """A null condition gives null, not the other branch."""
    return F.when(condition, then).when(~condition, other)


def least_native(*xs: Column) -> Column:
    """Null if any is null, as null is the lowest value."""
    some_null = xs[0].isNull()
    for x in xs[1:]:
        some_null = some_null | x.isNull()
    return F.when(~some_null, F.least(*xs) if len(xs) > 1 else xs[0])


def sqrt_native(x: Column) -> Column:
    """Null, not NaN, for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def binary_to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_to_binary(s: Column) -> Column:
    """An odd digit comes first, alone."""
    return F.unhex(s)


#: How dates are written in an English locale, short, medium, long and full; these are tried after yyyy-MM-dd.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "EEEE, MMMM d, yyyy")


def date_ob(x: Column | None = None, kind: str = "string") -> Column:
    """A date: today without an argument or for null, milliseconds since 1970, or text in one of DATE_FORMATS (null where it is in none).
    A weekday is not checked against the date."""
    if x is None:
        return F.current_date()
    if kind == "number":
        own = F.to_date(F.timestamp_millis(x.cast("long")))
    else:
        short = F.when(x.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), x)  # two digits of a year are of this century
        text = F.regexp_replace(x, r"^[A-Za-z]+, (?=[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$)", "")
        tries = [F.try_to_timestamp(short, F.lit("M/d/yy"))] + [F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(form)) for form, shape in (
            ("yyyy-MM-dd", "^[0-9]{4}-"), ("MMM d, yyyy", "^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"), ("MMMM d, yyyy", "^[A-Z][a-z]{3,} [0-9]{1,2}, [0-9]{4}$"))]
        own = F.coalesce(*tries).cast("date")
    return F.when(x.isNull(), F.current_date()).otherwise(own)


def time_ob(x: Column | None = None) -> Column:
    """A time of day as a timestamp on 1970-01-01, from HH:mm:ss with or without a fraction; now without an argument or for null."""
    now = F.concat(F.lit("1970-01-01 "), F.date_format(F.current_timestamp(), "HH:mm:ss.SSS")).cast("timestamp_ntz")
    return now if x is None else F.when(x.isNull(), now).otherwise(F.concat(F.lit("1970-01-01 "), x).try_cast("timestamp_ntz"))


def timestamp_ob(x: Column | None = None) -> Column:
    """A timestamp from text (null where it is none); now without an argument or for null."""
    now = F.localtimestamp()
    return now if x is None else F.when(x.isNull(), now).otherwise(x.try_cast("timestamp_ntz"))


def epoch_millis(x: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, as of UTC."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), x).cast("timestamp"))


#: JDBC's codes of foreign key rules.
FK_RULES = {"CASCADE": 0, "RESTRICT": 1, "SET NULL": 2, "NO ACTION": 3, "SET DEFAULT": 4}


def fk_rule_code(rule: Column) -> Column:
    """No rule is NO ACTION; another text than a rule is null."""
    out = F.when(rule.isNull() | (rule == ""), FK_RULES["NO ACTION"])
    for name, code in FK_RULES.items():
        out = out.when(rule == name, code)
    return out


def sql_type_text(name: Column, size: Column, scale: Column) -> Column:
    """TYPE, TYPE(size) or TYPE(size,scale); null and -1 stand for a size or scale that isn't given."""
    given = lambda x: x.isNotNull() & (x != -1)
    inner = F.concat(size.cast("string"), F.when(given(scale), F.concat(F.lit(","), scale.cast("string"))).otherwise(""))
    return F.when(given(size), F.concat(name, F.lit("("), inner, F.lit(")"))).otherwise(name)

"""Scalar functions, one query each, and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import scalars as C
from quillspark.functions.udfs import fold, register
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
both, plan = P.both, P.plan

# text
both("lower", "SELECT p_partkey, lower(p_brand) AS r FROM {part}")
both("upper", "SELECT p_partkey, upper(p_name) AS r FROM {part}")
both("concat", "SELECT p_partkey, concat(p_brand, ' / ', p_type) AS r FROM {part}")
both("length", "SELECT p_partkey, CAST(length(p_type) AS INT) AS r FROM {part}")
both("ltrim", "SELECT p_partkey, ltrim(concat('   ', p_brand, '  ')) AS r FROM {part}")
both("rtrim", "SELECT p_partkey, rtrim(concat('   ', p_brand, '  ')) AS r FROM {part}")
both("trim_both", "SELECT p_partkey, trim(concat('  ', p_brand, '  ')) AS r FROM {part}")
both("coalesce", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), p_type, 'none') AS r FROM {part}")


@plan("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand || p_type END AS r FROM part")
def concat_null(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT p_partkey, concat(nullif(p_brand, 'Brand#11'), p_type) AS r FROM {part}")


@plan("SELECT p_partkey, substr(p_type, 3, 4) AS r FROM part")
def substring0(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.substring0(F.col("p_type"), 2, 6).alias("r"))


@plan("SELECT p_partkey, substr(p_brand, 1, 2) AS a, substr(p_brand, 7) AS b, '' AS c, '' AS d, substr(p_brand, 6, 1) AS e FROM part")
def substring_edges(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.substring0(b, -3, 2).alias("a"), C.substring0(b, 6, 100).alias("b"), C.substring0(b, 4, 4).alias("c"),
        C.substring0(b, 50).alias("d"), C.substring0(b, 5, 6).alias("e"),
    )


@plan("SELECT p_partkey, ltrim(p_brand, 'B') AS r FROM part")
def trim_leading_char(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.trim_text(F.col("p_brand"), "B", "leading").alias("r"))


@plan("SELECT p_partkey, 'a' || p_brand || 'b' AS r, p_brand || '  ' || chr(10) AS s, chr(10) || ' ' || p_brand || chr(10) AS t FROM part")
def trim_multi(spark, sf_dir):
    text = lambda *parts: F.concat(*(F.col(x) if x == "p_brand" else F.lit(x) for x in parts))
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.trim_text(text("ababa", "p_brand", "bab"), "ab").alias("r"), C.trim_text(text("p_brand", "  \n")).alias("s"), C.trim_text(text("\n ", "p_brand", "\n  ")).alias("t")
    )


@plan("SELECT p_partkey, lower(hex(encode(p_brand))) AS r FROM part")
def binary_hex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.binary_to_hex(F.col("p_brand").cast("binary")).alias("r"))


@plan("SELECT p_partkey, p_brand AS r FROM part")
def hex_binary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.hex_to_binary(F.hex("p_brand")).cast("string").alias("r"))


# numbers
both("abs", "SELECT c_custkey, abs(c_acctbal) AS r FROM {customer}")
both("sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS INT) AS r FROM {customer}")
both("mod", "SELECT c_custkey, (c_nationkey - 12) % 5 AS r FROM {customer}")
both("round", "SELECT c_custkey, round(c_acctbal, 1) AS r FROM {customer}")
both("round_neg", "SELECT c_custkey, CAST(round(c_nationkey * 137, -2) AS BIGINT) AS r FROM {customer}")
both("pow", "SELECT c_custkey, pow(CAST(c_nationkey AS DOUBLE), 2) AS r FROM {customer}")
both("greatest", "SELECT c_custkey, greatest(c_nationkey, 10, nullif(c_nationkey % 20, 3)) AS r FROM {customer}")


@plan("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS r FROM customer")
def sqrt_neg_null(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(C.sqrt_native(F.col("c_acctbal")), 6).alias("r"))


@plan("SELECT c_custkey, CASE WHEN c_nationkey % 20 <> 3 THEN least(c_nationkey, 10, c_nationkey % 20) END AS r FROM customer")
def least_native(spark, sf_dir):
    k = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", C.least_native(k, F.lit(10), F.nullif(k % 20, F.lit(3))).alias("r"))


# dates
both("date_literal", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1997-06-01'")
both("timestamp_literal", "SELECT event_id FROM {events} WHERE ts < TIMESTAMP '2024-01-02 03:04:05'")
both("date_epoch", "SELECT o_orderkey, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01') AS BIGINT) * 86400000 AS r FROM {orders}", "SELECT o_orderkey, CAST(epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS r FROM orders")


@plan("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def to_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.date_ob(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))


@plan("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS short, CAST(o_orderdate AS DATE) AS long, CAST(o_orderdate AS DATE) AS whole FROM orders WHERE year(o_orderdate) < 2000")
def date_formats(spark, sf_dir):
    """Dates as an English locale writes them; two digits of a year are taken for this century, so a century is taken off again."""
    text = lambda form: C.date_ob(F.date_format("o_orderdate", form))
    out = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") < 2000)
    return out.select("o_orderkey", F.add_months(text("M/d/yy"), -1200).alias("short"), text("MMM d, yyyy").alias("long"), text("EEEE, MMMM d, yyyy").alias("whole"))


@plan("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS r FROM orders")
def dateformat(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("r"))


@plan("SELECT event_id, CAST(epoch_us(ts) // 1000 + 3600000 AS BIGINT) AS r FROM events")
def date_arith_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (C.epoch_millis(F.col("ts")) + 3_600_000).alias("r"))


@plan("SELECT event_id, CAST('1970-01-01 ' || strftime(ts, '%H:%M:%S') AS TIMESTAMP) AS r FROM events")
def time_of_day(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.time_ob(F.date_format("ts", "HH:mm:ss")).alias("r"))


@plan("SELECT event_id, date_trunc('second', ts) AS r FROM events")
def timestampob(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.timestamp_ob(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("r"))


# others
@plan("SELECT c_custkey, CASE WHEN k IS NULL THEN NULL WHEN k > 10 THEN 'high' ELSE 'low' END AS r FROM (SELECT c_custkey, nullif(c_nationkey, 4) AS k FROM customer)")
def if_native(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.if_native(F.nullif(F.col("c_nationkey"), F.lit(4)) > 10, F.lit("high"), F.lit("low")).alias("r"))


@plan("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS r, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM customer")
def tonumber(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.to_number(F.col("c_nationkey").cast("string")).alias("r"), C.to_number(F.col("c_acctbal") > 0, "boolean").alias("b"))


@plan("SELECT c_custkey, 0.0::DOUBLE AS r FROM customer")
def tonumber_bad_zero(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.to_number(F.col("c_name")).alias("r"))


@plan("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS unique_key FROM customer")
def unique_key(spark, sf_dir):
    from quillspark.operators.relational import numbered

    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], "unique_key")


@plan("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'NUMERIC' WHEN p_size % 3 = 1 THEN 'NUMERIC(' || p_size || ')' ELSE 'NUMERIC(' || p_size || ',2)' END AS r FROM part")
def sql_type_string(spark, sf_dir):
    size, kind = F.col("p_size"), F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", C.sql_type_text(F.lit("NUMERIC"), F.when(kind != 0, size), F.when(kind == 2, 2).otherwise(-1)).alias("r"))


@plan("SELECT r_regionkey, [0, 1, 2, 3, 4][r_regionkey + 1] AS r FROM region")
def fk_rule_code(spark, sf_dir):
    rule = F.element_at(F.array(*map(F.lit, ("CASCADE", "RESTRICT", "SET NULL", "NO ACTION", "SET DEFAULT"))), F.col("r_regionkey") + 1)
    return table(spark, sf_dir, "region").select("r_regionkey", C.fk_rule_code(rule).alias("r"))


# user-defined functions
def _twice_and_one(x: pd.Series) -> pd.Series:
    return x * 2 + 1


@plan("SELECT p_partkey, p_size * 2 + 1 AS r FROM part")
def udf_scalar(spark, sf_dir):
    register(spark, {"twice_and_one": (_twice_and_one, "int")})
    return sql(spark, sf_dir, "SELECT p_partkey, twice_and_one(p_size) AS r FROM {part}")


@plan("SELECT p_brand, CAST(max(p_size) - min(p_size) AS BIGINT) AS r FROM part GROUP BY p_brand")
def udaf_grouped(spark, sf_dir):
    ends = lambda a, b: b if a is None else (min(a[0], b[0]), max(a[1], b[1]))
    step = lambda a, v: ends(a, (int(v), int(v)))
    return fold(table(spark, sf_dir, "part"), ["p_brand"], "p_size", None, step, ends, lambda a: a[1] - a[0], "bigint", "r")


@plan(None)
def user(spark, sf_dir):
    return spark.range(1).select(F.current_user().alias("user"), C.date_ob().alias("today"))

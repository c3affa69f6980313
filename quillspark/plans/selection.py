"""Scans, projections, filters, patterns, arithmetic and the null-lowest comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import semantics as S
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
both, plan = P.both, P.plan

# scans and projections
both("scan_region", "SELECT r_regionkey, r_name FROM {region}")
both("scan_star", "SELECT * FROM {nation}")
both("project_cols", "SELECT o_orderkey, o_orderstatus FROM {orders}")
both("project_alias", "SELECT c_custkey AS customer_id, c_name AS customer FROM {customer}")
both("project_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 2, 2) AS doubled FROM {lineitem}")
both("table_star", "SELECT n.* FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey AND r.r_name < 'B'")
both("select_no_from", "SELECT 1 + 2 AS three, 'x' AS letter")
both("derived_table", "SELECT d.o_orderkey AS orderkey FROM (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000) d")


@plan("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 3")
def view_subquery(spark, sf_dir):
    table(spark, sf_dir, "customer").filter("c_acctbal > 5000").createOrReplaceTempView("rich_customers")
    return spark.sql("SELECT c_custkey, c_name FROM rich_customers WHERE c_nationkey = 3")


# filters
ORDERS = "SELECT o_orderkey, o_custkey FROM {orders} WHERE "
both("eq", ORDERS + "o_orderstatus = 'F'")
both("ne", ORDERS + "o_orderstatus <> 'F'")
both("lt", ORDERS + "o_custkey < 100")
both("le", ORDERS + "o_custkey <= 100")
both("gt", ORDERS + "o_totalprice > 150000")
both("ge", ORDERS + "o_totalprice >= 150000")
both("between", ORDERS + "o_custkey BETWEEN 50 AND 150")
both("not_between", ORDERS + "o_custkey NOT BETWEEN 50 AND 1400")
both("in_list", ORDERS + "o_orderpriority IN ('1-URGENT', '2-HIGH', 'LOW')")
both("not_in_list", ORDERS + "o_orderstatus NOT IN ('F', 'O')")
both("and_or_not", ORDERS + "(o_custkey < 100 AND o_totalprice > 1000) OR NOT (o_orderstatus = 'O')")
both("demorgan", ORDERS + "NOT (o_custkey >= 100 OR o_orderstatus <> 'F')")
both("is_null", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} WHERE nullif(o_orderstatus, 'F') IS NULL")
both("is_not_null", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} WHERE nullif(o_orderstatus, 'F') IS NOT NULL")
both("const_false", ORDERS + "1 = 0")
both("bool_expr", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 200000 AS large FROM {orders}) x WHERE large")
both("or_across_tables", "SELECT o_orderkey, c_custkey FROM {orders}, {customer} WHERE o_custkey = c_custkey AND (o_totalprice > 400000 OR c_acctbal < -500)")
both("date_range", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 OR o_totalprice > 300000.0")
def param_bind(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = ? OR o_totalprice > ?", [37, 300000.0])


# patterns
PART = "SELECT p_partkey, p_name FROM {part} WHERE "
both("like_prefix", PART + "p_type LIKE 'STANDARD%'")
both("like_suffix", PART + "p_brand LIKE '%3'")
both("like_infix", PART + "p_name LIKE '%1%'")
both("like_single", PART + "p_brand LIKE 'Brand#_2'")
both("like_escape", "SELECT p_partkey FROM {part} WHERE concat(p_brand, '%') LIKE '%2\\\\%'", "SELECT p_partkey FROM part WHERE concat(p_brand, '%') LIKE '%2\\%' ESCAPE '\\'")
both("not_like", PART + "p_type NOT LIKE '%S%'")
both("like_null", "SELECT p_partkey FROM {part} WHERE nullif(p_brand, 'Brand#11') NOT LIKE '%2'")


@plan("SELECT o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '1%5'")
def like_on_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(S.like(F.col("o_custkey"), "1%5")).select("o_orderkey")


@plan("SELECT p_partkey FROM part WHERE regexp_full_match(CASE WHEN p_partkey % 3 = 0 THEN p_brand || chr(10) ELSE p_brand END, 'Brand#[1-3]+')")
def regex_full(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("\n"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").filter(S.regex_full(brand, "Brand#[1-3]+")).select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'bRAND#.[24]', 'i')")
def regex_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(S.regex_full(F.col("p_brand"), "bRAND#.[24]", "i")).select("p_partkey")


# null-lowest comparisons, over columns in which some values are made null
NULLED = "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 2) AS a, nullif(CAST(l_quantity AS INT) % 5, 3) AS b FROM {lineitem}"
_DUCK = "SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 2) AS a, nullif(CAST(trunc(l_quantity) AS INT) % 5, 3) AS b FROM lineitem"
_NATIVE = {
    "eq": (S.eq, "a IS NOT DISTINCT FROM b"), "ne": (S.ne, "a IS DISTINCT FROM b"),
    "lt": (S.lt, "(a IS NULL AND b IS NOT NULL) OR coalesce(a < b, false)"), "le": (S.le, "a IS NULL OR coalesce(a <= b, false)"),
    "gt": (S.gt, "(b IS NULL AND a IS NOT NULL) OR coalesce(a > b, false)"), "ge": (S.ge, "b IS NULL OR coalesce(a >= b, false)"),
}
for _name, (_op, _text) in _NATIVE.items():
    P.queries[f"native_{_name}"] = lambda spark, sf_dir, op=_op: sql(spark, sf_dir, NULLED).filter(op(F.col("a"), F.col("b")))
    P.oracle[f"native_{_name}"] = f"SELECT * FROM ({_DUCK}) WHERE {_text}"


@plan(f"SELECT * FROM ({_DUCK}) WHERE (a IS NULL) OR coalesce(a < 2, false) OR coalesce(a > 4, false)")
def native_not_between(spark, sf_dir):
    return sql(spark, sf_dir, NULLED).filter(S.not_between(F.col("a"), F.lit(2), F.lit(4)))


@plan(f"SELECT * FROM ({_DUCK}) WHERE a IS NULL OR a = 4")
def native_in_list(spark, sf_dir):
    return sql(spark, sf_dir, NULLED).filter(S.in_list(F.col("a"), F.lit(4), F.lit(None)))


# arithmetic
both("add", "SELECT l_orderkey, l_linenumber + l_suppkey AS r FROM {lineitem}")
both("sub", "SELECT l_orderkey, l_suppkey - l_linenumber AS r FROM {lineitem}")
both("mul", "SELECT l_orderkey, l_suppkey * l_linenumber AS r FROM {lineitem}")
both("precedence_paren", "SELECT l_orderkey, 10 - (5 - l_linenumber) * 2 + l_linenumber AS r FROM {lineitem}")
both("arith_null", "SELECT l_orderkey, l_suppkey + nullif(l_linenumber, 3) AS r FROM {lineitem}")


@plan("SELECT l_orderkey, l_linenumber, round(l_suppkey / l_linenumber, 10) AS r FROM lineitem")
def div10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.div10(F.col("l_suppkey"), F.col("l_linenumber")).alias("r"))


@plan("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN round(l_suppkey / (l_linenumber - 1), 10) END AS r FROM lineitem")
def div_zero_null(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.div10(F.col("l_suppkey"), F.col("l_linenumber") - 1).alias("r"))

"""Aggregation, ordering, limits, distinct rows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
both, plan = P.both, P.plan

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)".format
both("group_cols", f"SELECT l_returnflag, l_linestatus, {MONEY('l_quantity')} AS sum_qty, count(*) AS n FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus")
both("group_expr", "SELECT o_custkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY o_custkey % 10")
both("group_alias", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 7 AS k FROM {orders}) x GROUP BY k")
both("global_agg", f"SELECT count(*) AS n, {MONEY('o_totalprice')} AS total FROM {{orders}}")
both("empty_global_agg", "SELECT count(*) AS n, max(o_custkey) AS most FROM {orders} WHERE 1 = 0")
both("count_star", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
both("count_expr", "SELECT o_orderpriority, count(nullif(o_orderstatus, 'F')) AS n FROM {orders} GROUP BY o_orderpriority")
both("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM {orders} GROUP BY o_orderstatus")
both("count_distinct_multi", "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY l_returnflag")
both("sum", f"SELECT c_nationkey, {MONEY('c_acctbal')} AS total FROM {{customer}} GROUP BY c_nationkey")
both("avg", "SELECT l_returnflag, round(avg(l_linenumber), 8) AS mean FROM {lineitem} GROUP BY l_returnflag")
both("min", "SELECT o_custkey, min(o_totalprice) AS least FROM {orders} GROUP BY o_custkey")
both("max", "SELECT o_custkey, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey")
both("having", f"SELECT o_custkey, {MONEY('o_totalprice')} AS total FROM {{orders}} GROUP BY o_custkey HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 1000000")
both("agg_expr", "SELECT l_returnflag, round(CAST(sum(l_linenumber) AS DOUBLE) / count(*), 8) AS ratio, max(l_linenumber) - min(l_linenumber) AS span FROM {lineitem} GROUP BY l_returnflag")


@plan("SELECT o_orderstatus, CAST(count(DISTINCT coalesce(CAST(nullif(o_custkey % 10, 3) AS VARCHAR), 'null')) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def count_distinct_null(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT o_orderstatus, nullif(o_custkey % 10, 3) AS k FROM {orders}")
    return rows.groupBy("o_orderstatus").agg(R.count_distinct_native(F.col("k")).alias("n"))


@plan("SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def group_max(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return R.group_max(rows, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@plan("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def first_row(spark, sf_dir):
    return R.first_row(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


_V = "SELECT l_returnflag, nullif(l_linenumber, 4) AS v FROM {lineitem}"


@plan("SELECT l_returnflag, round(CAST(sum(nullif(l_linenumber, 4)) AS DOUBLE) / count(*), 10) AS mean FROM lineitem GROUP BY l_returnflag")
def native_avg(spark, sf_dir):
    return sql(spark, sf_dir, _V).groupBy("l_returnflag").agg(R.avg_native(F.col("v")).alias("mean"))


@plan("SELECT l_orderkey, CASE WHEN count(nullif(l_linenumber, 4)) = count(*) THEN min(nullif(l_linenumber, 4)) END AS least FROM lineitem GROUP BY l_orderkey")
def native_min(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT l_orderkey, nullif(l_linenumber, 4) AS v FROM {lineitem}")
    return rows.groupBy("l_orderkey").agg(R.min_native(F.col("v")).alias("least"))


@plan("SELECT o_custkey, CASE WHEN arg_min(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, o_orderkey) = 1 THEN CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) AS BIGINT) END AS total FROM orders GROUP BY o_custkey")
def native_sum(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS v FROM {orders}")
    return rows.groupBy("o_custkey").agg(R.sum_native(F.col("v"), F.col("o_orderkey")).alias("total"))


# order and limit
both("order_asc", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey ASC")
both("order_desc", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey DESC")
both("order_multi", "SELECT n_regionkey, n_name FROM {nation} ORDER BY n_regionkey DESC, n_name ASC")
both("order_expr", "SELECT n_name FROM {nation} ORDER BY n_nationkey % 3, n_name")
both("order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM {nation} ORDER BY k NULLS FIRST, n_nationkey")
both("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
both("distinct_ordered", "SELECT DISTINCT c_mktsegment FROM {customer} ORDER BY c_mktsegment")


@plan("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20 OFFSET 100")
def page_offset(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100, 20)


@plan("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def first_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@plan("SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY -r_regionkey) AS i FROM region) b USING (i)")
def column_merge(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select("r_name", (-F.col("r_regionkey")).alias("k"))
    return R.zip_columns(table(spark, sf_dir, "nation").select("n_name"), regions, ["n_name"], ["k"]).drop("k")


@plan("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def end_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(R.end_value("o_orderkey", "o_orderkey").alias("first"), R.end_value("o_orderkey", "o_orderkey", last=True).alias("last"))


@plan("SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status FROM orders GROUP BY o_custkey")
def single_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(R.single_value("o_orderstatus").alias("status"))


@plan("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 1")
def rest_rows(spark, sf_dir):
    return R.rest(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


both("row_cap", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 50")


# set operations
_X, _Y = "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM {orders} WHERE o_orderpriority = '1-URGENT'"
both("union_all", f"{_X} UNION ALL {_Y}")
both("union", f"{_X} UNION {_Y}")
both("intersect", f"{_X} INTERSECT {_Y}")
both("intersect_all", f"{_X} INTERSECT ALL {_Y}")
both("except", f"{_X} EXCEPT {_Y}")
both("except_all", f"{_X} EXCEPT ALL {_Y}")
both("set_chain", f"{_X} EXCEPT ({_Y} EXCEPT (SELECT c_custkey AS k FROM {{customer}} WHERE c_nationkey < 10))")
both("set_order", f"SELECT k FROM ({_X} UNION ALL {_Y}) u ORDER BY k")

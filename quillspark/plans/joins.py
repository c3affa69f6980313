"""Joins and subqueries, quantified ones included."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import semantics as S
from quillspark.operators import relational as R
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
both, plan = P.both, P.plan

both("cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
both("comma_join", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
both("inner_on", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
both("equi2", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
both("theta", "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_nationkey <> b.n_nationkey")
both("range_join", "SELECT a.n_name AS lower, b.n_name AS higher FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey")
both("expr_join", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_nationkey % 5 = (r_regionkey + 1) % 5")
both("left_outer", "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
both("right_outer", "SELECT o_orderkey, l_linenumber FROM {lineitem} RIGHT JOIN {orders} ON o_orderkey = l_orderkey AND l_linenumber > 5")
both("self_join", "SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM {supplier} a, {supplier} b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
both("three_way", "SELECT o_orderkey, c_name, n_name FROM {orders}, {customer}, {nation} WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_name < 'C'")
both("left_outer_where_ansi", "SELECT o_orderkey FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
both("full_outer", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 200000) o FULL JOIN (SELECT * FROM {customer} WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")


@plan("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10) l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def native_outer_prefilter(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    out = R.outer_join_prefiltered(o, l, o["o_orderkey"] == l["l_orderkey"], o["o_orderstatus"] == "F", (l["l_linenumber"] == 1) & (l["l_quantity"] < 10))
    return out.select("o_orderkey", "l_linenumber")


_A = "SELECT n_name AS an, nullif(n_regionkey, 1) AS ak FROM {nation}"
_B = "SELECT r_name AS bn, nullif(r_regionkey, 2) AS bk FROM {region}"


@plan("SELECT an, bn FROM (SELECT n_name AS an, nullif(n_regionkey, 1) AS ak FROM nation) a JOIN (SELECT r_name AS bn, nullif(r_regionkey, 2) AS bk FROM region) b ON ak IS NOT DISTINCT FROM bk")
def native_null_key_join(spark, sf_dir):
    return R.join_null_keys(sql(spark, sf_dir, _A), sql(spark, sf_dir, _B), [("ak", "bk")]).select("an", "bn")


# subqueries
both("semi_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)")
both("anti_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)")
both("correlated_any", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice IN (SELECT max(x.o_totalprice) FROM {orders} x WHERE x.o_custkey = o.o_custkey)")
both("correlated_avg", "SELECT s_suppkey FROM {supplier} s WHERE s_acctbal > (SELECT avg(x.s_acctbal) FROM {supplier} x WHERE x.s_nationkey = s.s_nationkey)")
both("having_subquery", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 700 FROM {orders})")

_SUPPLIERS = "SELECT s_acctbal FROM supplier WHERE s_nationkey = {}"
_NAMES = {"=": "eq", "<>": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}


def _quantified(op: str, quantifier: str, nation: int):
    def query(spark, sf_dir):
        values = table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") == nation)
        return R.quantified(table(spark, sf_dir, "customer"), "c_acctbal", op, quantifier, values, "s_acctbal").select("c_custkey", "c_acctbal")

    return query


for _op, _name in _NAMES.items():
    for _q in ("any", "all"):
        P.queries[f"{_name}_{_q}"] = _quantified(_op, _q, 7)
        P.oracle[f"{_name}_{_q}"] = f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal {_op} {_q.upper()} ({_SUPPLIERS.format(7)})"
        P.queries[f"{_name}_{_q}_empty"] = _quantified(_op, _q, 99)
        P.oracle[f"{_name}_{_q}_empty"] = f"SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal {_op} {_q.upper()} ({_SUPPLIERS.format(99)})"
# quantifiers over few integers, where equality happens
for _op, _q in (("=", "any"), ("<>", "all"), ("=", "all"), ("<>", "any")):
    P.queries[f"{_NAMES[_op]}_{_q}_int"] = lambda spark, sf_dir, op=_op, q=_q: R.quantified(
        table(spark, sf_dir, "customer"), "c_nationkey", op, q, table(spark, sf_dir, "nation").filter("n_regionkey = 2"), "n_nationkey"
    ).select("c_custkey")
    P.oracle[f"{_NAMES[_op]}_{_q}_int"] = f"SELECT c_custkey FROM customer WHERE c_nationkey {_op} {_q.upper()} (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"


@plan("SELECT o_orderkey FROM orders WHERE o_custkey > 1400 OR o_custkey > 1450")
def any_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(S.any_of(F.col("o_custkey"), ">", F.lit(1400), F.lit(1450))).select("o_orderkey")


@plan("SELECT o_orderkey FROM orders WHERE o_custkey <> 3 AND o_custkey <> 4")
def all_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(S.all_of(F.col("o_custkey"), "<>", F.lit(3), F.lit(4))).select("o_orderkey")


@plan("SELECT an FROM (SELECT n_name AS an, nullif(n_regionkey, 1) AS ak FROM nation) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(r_regionkey, 2) AS bk FROM region WHERE r_regionkey > 1) b WHERE ak IS NOT DISTINCT FROM bk)")
def native_not_in_null(spark, sf_dir):
    values = sql(spark, sf_dir, "SELECT nullif(r_regionkey, 2) AS bk FROM {region} WHERE r_regionkey > 1")
    return R.quantified(sql(spark, sf_dir, _A), "ak", "<>", "all", values, "bk", native=True).select("an")


@plan("SELECT an FROM (SELECT n_name AS an, nullif(n_regionkey, 1) AS ak FROM nation) a WHERE ak IS NOT NULL")
def native_gt_any_null(spark, sf_dir):
    values = sql(spark, sf_dir, "SELECT nullif(r_regionkey, 2) AS bk FROM {region} WHERE r_regionkey > 1")
    return R.quantified(sql(spark, sf_dir, _A), "ak", ">", "any", values, "bk", native=True).select("an")

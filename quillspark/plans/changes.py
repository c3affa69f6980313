"""INSERT, UPDATE, DELETE and the constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import changes as D
from quillspark.operators import constraints as K
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
plan = P.plan


@plan("SELECT * FROM region UNION ALL VALUES (5, 'ATLANTIS'), (6, NULL)")
def insert_values(spark, sf_dir):
    return D.insert_values(table(spark, sf_dir, "region"), [(5, "ATLANTIS"), (6, None)])


@plan("SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def insert_select(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT n_nationkey + 100 AS a, n_name AS b FROM {nation} WHERE n_regionkey = 2")
    return D.insert_select(table(spark, sf_dir, "region"), rows)


@plan("SELECT * FROM nation UNION ALL SELECT 77, 'NOWHERE', 1")
def insert_set(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return D.insert_select(rows, D.insert_set(rows.limit(0), n_name="NOWHERE", n_nationkey=77).drop("n_regionkey"), ["n_nationkey", "n_name"], {"n_regionkey": 1})


@plan("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(spark, sf_dir):
    return D.update(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.lit("B")})


_FIRST = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 10)"


@plan(f"SELECT c_custkey, CASE WHEN c_custkey IN {_FIRST} THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_limit(spark, sf_dir):
    return D.update(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0)}, 10, ["c_custkey"], ["c_acctbal"])


@plan("SELECT o_orderkey, status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders) WHERE status IS NULL OR status <> 'F'")
def delete_where(spark, sf_dir):
    return D.delete(sql(spark, sf_dir, "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM {orders}"), F.col("status") == "F")


@plan(f"SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN {_FIRST}")
def delete_limit(spark, sf_dir):
    return D.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, 10, ["c_custkey"], ["c_acctbal"])


@plan("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE c_nationkey = 3")
def not_null_viol(spark, sf_dir):
    return K.null_violations(sql(spark, sf_dir, "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer}"), ["c_custkey", "k"])


@plan("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_viol(spark, sf_dir):
    return K.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@plan("SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_custkey, 55) AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 6)")
def fk_viol(spark, sf_dir):
    child = sql(spark, sf_dir, "SELECT o_orderkey, nullif(o_custkey, 55) AS k FROM {orders}")
    return K.foreign_key_violations(child, ["k"], table(spark, sf_dir, "customer").filter("c_nationkey <> 6"), ["c_custkey"])


@plan("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) WHERE k >= 20")
def check_viol(spark, sf_dir):
    return K.check_violations(sql(spark, sf_dir, "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer}"), F.col("k") < 20)


@plan(
    "SELECT 'CHECK small_key' AS rule, count(*) AS n FROM orders WHERE o_custkey > 1000 HAVING count(*) > 0 UNION ALL "
    "SELECT 'FOREIGN KEY o_custkey', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 6) HAVING count(*) > 0"
)
def table_violations(spark, sf_dir):
    orders = K.Table(
        "orders", (("o_orderkey", "bigint"), ("o_custkey", "bigint")), not_null=("o_custkey",), primary_key=("o_orderkey",),
        checks=(("small_key", "o_custkey <= 1000"),), foreign_keys=((("o_custkey",), "customer", ("c_custkey",)),),
    )
    return orders.violations(table(spark, sf_dir, "orders"), {"customer": table(spark, sf_dir, "customer").filter("c_nationkey <> 6")})

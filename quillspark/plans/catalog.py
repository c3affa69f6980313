"""Table definitions, SHOW and DESCRIBE, scripts, backups, schemas, and what a deletion does to rows that refer to what is gone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import constraints as K
from quillspark.operators import ledger as L
from quillspark.plans.base import Plans
from quillspark.sources import catalog as C
from quillspark.sources.shared import keep, shared_dir
from quillspark.sources.tables import as_text, backup, restore, run_script, sql, system_tables, table

P = Plans()
plan = P.plan

#: What the tables' files hold: column, Spark's type.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}


def _values(*tables: str) -> str:
    return ", ".join(f"('{t}', {i}, '{c.split()[0]}', '{c.split()[1]}', true)" for t in tables for i, c in enumerate(_COLUMNS[t].split(", ")))


@plan(f"SELECT * FROM (VALUES {_values('region', 'nation', 'orders')}) t(table_name, position, column_name, data_type, nullable)")
def catalog_tables(spark, sf_dir):
    return system_tables(spark, sf_dir, ["region", "nation", "orders"])


@plan(f"SELECT position, column_name, data_type, nullable FROM (VALUES {_values('orders')}) t(table_name, position, column_name, data_type, nullable)")
def describe_table(spark, sf_dir):
    return C.describe(table(spark, sf_dir, "orders"))


@plan(f"SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in C.TYPES.items())}) t(type_name, spark_type)")
def show_types(spark, sf_dir):
    return C.show_types(spark)


@plan("SELECT * FROM (VALUES ('TABLE'), ('TEMPORARY'), ('VIEW')) t(table_type)")
def show_table_types(spark, sf_dir):
    return C.show_table_types(spark)


@plan(None)
def show_session(spark, sf_dir):
    return C.show_product(spark).union(C.show_connection(spark)).union(C.show_status(spark))


@plan(None)
def show_schemas(spark, sf_dir):
    return C.show_schemas(spark)


def _orders(name: str = "orders") -> K.Table:
    return K.Table(
        name, (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string")), not_null=("o_custkey",), primary_key=("o_orderkey",),
        checks=(("known", "o_orderstatus IN ('F', 'O', 'P')"),), foreign_keys=((("o_custkey",), "customer", ("c_custkey",), "CASCADE"),), defaults={"o_orderstatus": "O"},
    )


@plan(
    "SELECT * FROM (VALUES ('orders', 'PRIMARY', 1, 'o_orderkey', NULL, NULL, NULL), ('orders', 'FOREIGN', 1, 'o_custkey', 'customer', 'c_custkey', 'CASCADE'), "
    "('customer', 'PRIMARY', 1, 'c_custkey', NULL, NULL, NULL)) t(table_name, key_type, key_seq, column_name, parent_name, parent_column, delete_rule)"
)
def show_keys(spark, sf_dir):
    return C.show_keys(spark, _orders(), K.Table("customer", (("c_custkey", "bigint"),), primary_key=("c_custkey",)))


@plan("SELECT * FROM (VALUES ('o_orderkey', 'bigint', true, NULL), ('o_custkey', 'bigint', false, NULL), ('o_orderstatus', 'string', false, 'O')) t(column_name, data_type, in_primary_key, default_value)")
def create_table(spark, sf_dir):
    """A definition that has been stored in the catalog and read back."""
    t = _orders(f"quill_{uuid.uuid4().hex}")
    C.create(spark, t)
    held = C.definition(spark, t.name)
    C.drop(spark, t.name)
    return spark.createDataFrame([(n, k, n in held.primary_key, held.defaults.get(n)) for n, k in held.columns], "column_name string, data_type string, in_primary_key boolean, default_value string")


@plan("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, 'new' AS note FROM orders")
def alter_table(spark, sf_dir):
    """The rows of a stored table after a column has been added, one dropped (a check goes with it), and one has another type."""
    t = _orders(f"quill_{uuid.uuid4().hex}").drop_foreign_key("o_custkey")
    C.create(spark, t)
    t.fitted(table(spark, sf_dir, "orders")).write.mode("append").saveAsTable(t.name)
    out = C.alter(spark, t.name, lambda d: d.add_column("note", "string", "new").drop_column("o_orderstatus").set_type("o_custkey", "string").add_unique("o_orderkey"))
    out = keep(out, "altered")
    C.drop(spark, t.name)
    return out


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 6)")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_nationkey = 6")
    return _orders().after_delete(table(spark, sf_dir, "orders"), "customer", gone).select("o_orderkey", "o_custkey")


_GONE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 6)"


@plan(f"SELECT o_orderkey, CASE WHEN {_GONE} THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN {_GONE} THEN 1 ELSE o_custkey END AS with_default FROM orders")
def delete_set_null(spark, sf_dir):
    orders, gone = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").filter("c_nationkey = 6")
    other = K.on_delete(orders, ["o_custkey"], gone, ["c_custkey"], "SET DEFAULT", {"o_custkey": 1}).withColumnRenamed("o_custkey", "with_default")
    return K.on_delete(orders, ["o_custkey"], gone, ["c_custkey"], "SET NULL").join(other, "o_orderkey")


@plan("SELECT CAST(o_orderkey AS DECIMAL(38,0)) AS o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS extra FROM orders WHERE o_custkey = 7")
def backup_restore(spark, sf_dir):
    """One company's rows (here: one customer's) through a backup into a table of other columns."""
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    backup(table(spark, sf_dir, "orders"), path, 7, "o_custkey")
    return restore(spark, path, spark.createDataFrame([], "o_orderkey decimal(38,0), o_custkey bigint, extra string"))


@plan("SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def script(spark, sf_dir):
    """The last result of a script with comments and statements that do nothing."""
    return run_script(spark, sf_dir, "-- customers\nSELECT 1 AS x;\n// by nation\nCREATE INDEX i ON customer(c_nationkey);\nSELECT n_name, count(*) AS n\nFROM {nation} JOIN {customer} ON n_nationkey = c_nationkey GROUP BY n_name;\n")[-1]


@plan(
    "WITH w AS (SELECT CAST(greatest(max(length(CAST(r_regionkey AS VARCHAR))), 11) AS INT) AS a, CAST(greatest(max(length(r_name)), 6) AS INT) AS b FROM region) "
    "SELECT CAST(0 AS BIGINT) AS n, rpad('r_regionkey', a, ' ') || ' | ' || rpad('r_name', b, ' ') AS line FROM w UNION ALL SELECT 1, repeat('-', a) || '-+-' || repeat('-', b) FROM w "
    "UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), rpad(CAST(r_regionkey AS VARCHAR), a, ' ') || ' | ' || rpad(coalesce(r_name, 'NULL'), b, ' ') FROM region, w"
)
def text_lines(spark, sf_dir):
    return as_text(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


_PERIODS = [(1, "1993-01-01", "1994-12-31"), (1, "1996-01-01", "1996-06-30"), (2, "1992-06-01", "1998-01-31")]


@plan(
    "WITH a AS (SELECT 1 + o_orderkey % 2 AS CompId, o_orderkey AS Act_id, CAST(o_orderdate AS DATE) AS InvDate FROM orders), "
    f"p(c, s, e) AS (VALUES {', '.join(f"({c}, DATE '{s}', DATE '{e}')" for c, s, e in _PERIODS)}) "
    "SELECT CompId, Act_id, InvDate FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE c = CompId AND InvDate BETWEEN s AND e)"
)
def outside_periods(spark, sf_dir):
    activity = sql(spark, sf_dir, "SELECT 1 + o_orderkey % 2 AS CompId, o_orderkey AS Act_id, CAST(o_orderdate AS DATE) AS InvDate FROM {orders}")
    periods = spark.createDataFrame(_PERIODS, "CompId int, s string, e string").select("CompId", F.to_date("s").alias("StartPeriod"), F.to_date("e").alias("EndPeriod"))
    return L.outside_periods(activity, periods)


@plan(
    "SELECT 1 + n_nationkey % 2 AS CompId, n_name AS UniqName, CASE WHEN n_name = 'CHINA' AND n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey + 1 <= 18 THEN n_nationkey + 1 ELSE 1 END ELSE n_nationkey END AS LastNumber FROM nation "
    "UNION ALL SELECT 1, 'CHINA', 1 WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'CHINA' AND n_nationkey % 2 = 0)"
)
def advance_number(spark, sf_dir):
    return L.advance_number(sql(spark, sf_dir, "SELECT 1 + n_nationkey % 2 AS CompId, n_name AS UniqName, n_nationkey AS LastNumber FROM {nation}"), 1, "CHINA", 1, 18)

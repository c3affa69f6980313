"""Ledger reports over order lines: an order is an activity, a part's number gives the account, and a returned line is a credit."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import ledger as L
from quillspark.plans.base import Plans
from quillspark.sources.tables import sql, table

P = Plans()
plan = P.plan

START, END = "1995-01-01", "1996-12-31"
_LINES = "SELECT 1 + l_orderkey % 2 AS CompId, l_orderkey AS Act_id, 1000 + l_partkey % 100 * 80 AS Account, l_extendedprice AS Amount, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS IsDebit, CAST(l_suppkey AS INT) AS Customer, concat('line ', CAST(l_linenumber AS STRING)) AS Notes FROM {lineitem}"
_ORDERS = "SELECT 1 + o_orderkey % 2 AS CompId, o_orderkey AS Act_id, o_orderdate AS InvDate FROM {orders}"
_ACCOUNTS = "SELECT DISTINCT c.CompId, 1000 + p_partkey % 100 * 80 AS Account, concat('Account ', CAST(p_partkey % 100 AS STRING)) AS AccDesc, CASE WHEN p_partkey % 100 < 25 THEN 1 ELSE 0 END AS IsAsset FROM {part}, (SELECT 1 AS CompId UNION ALL SELECT 2) c"


def _books(spark, sf_dir):
    return sql(spark, sf_dir, _LINES), sql(spark, sf_dir, _ORDERS), sql(spark, sf_dir, _ACCOUNTS)


def _lines(spark, sf_dir):
    return L.lines(*_books(spark, sf_dir), 1)


def _text(s: str) -> str:
    return s.replace("{", "").replace("}", "").replace("AS STRING", "AS VARCHAR")


_SIGNED = "CASE WHEN IsDebit = 1 THEN CAST(Amount AS DECIMAL(18,2)) ELSE -CAST(Amount AS DECIMAL(18,2)) END"
_J = (
    f"WITH j AS (SELECT m.*, a.InvDate, c.AccDesc, c.IsAsset, {_SIGNED} AS s FROM ({_text(_LINES)}) m JOIN ({_text(_ORDERS)}) a USING (CompId, Act_id) "
    f"JOIN ({_text(_ACCOUNTS)}) c USING (CompId, Account) WHERE CompId = 1), "
    f"b AS (SELECT Account, AccDesc, IsAsset, coalesce(sum(CASE WHEN CAST(InvDate AS DATE) < DATE '{START}' THEN s END), 0) AS every, "
    f"coalesce(sum(CASE WHEN CAST(InvDate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' THEN s END), 0) AS period FROM j WHERE CAST(InvDate AS DATE) <= DATE '{END}' GROUP BY ALL), "
    "bal AS (SELECT Account, AccDesc, IsAsset, CASE WHEN IsAsset = 1 THEN every END AS opening, period, CASE WHEN IsAsset = 1 THEN every + period END AS outgoing "
    "FROM b WHERE period <> 0 OR (IsAsset = 1 AND every <> 0)) "
)


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _as_double(*names):
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


@plan(_J + f"SELECT Account, AccDesc, IsAsset, {_as_double('opening', 'period')} FROM bal")
def balance(spark, sf_dir):
    return _doubles(L.balance(_books(spark, sf_dir), 1, START, END).drop("outgoing"), "opening", "period")


@plan(_J + f"SELECT Account, {_as_double('outgoing')} FROM bal WHERE outgoing IS NOT NULL")
def balance_outgoing(spark, sf_dir):
    return _doubles(L.balance(_books(spark, sf_dir), 1, START, END).select("Account", "outgoing").filter("outgoing IS NOT NULL"), "outgoing")


@plan(_J + "SELECT IsAsset AS is_asset, CAST(sum(opening) AS DOUBLE) AS opening, CAST(sum(period) AS DOUBLE) AS period, CAST(sum(outgoing) AS DOUBLE) AS outgoing FROM bal GROUP BY IsAsset")
def balance_subtotals(spark, sf_dir):
    return _doubles(L.balance_subtotals(_books(spark, sf_dir), 1, START, END), "opening", "period", "outgoing")


_SPEC = [(1000, 2999, "Balance", True, False, "10"), (3000, 9999, "Result", False, False, "11"), (2500, 4000, "Middle", True, True, "12"), (9500, 9999, "Rest", False, True, "13")]
_GROUPS = [("10", "Difference", False, "1"), ("11", "", True, "1"), ("12", "Second", False, "2")]


def _account_sum(spark, sf_dir):
    spec = spark.createDataFrame(_SPEC, "`from` int, `to` int, comment string, before boolean, minus boolean, grp string")
    groups = spark.createDataFrame(_GROUPS, "grp1 string, comment string, minus boolean, grp2 string")
    return L.account_sum(_books(spark, sf_dir), 1, spec, groups, START, END), groups


_S = (
    _J + ", spec(lo, hi, comment, before, minus, grp1) AS (VALUES " + ", ".join(f"({a}, {b}, '{c}', {d}, {e}, '{g}')" for a, b, c, d, e, g in _SPEC)
    + "), groups(grp1, gcomment, gminus, grp2) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in _GROUPS)
    + "), m AS (SELECT coalesce(grp2, '999999') AS grp2, spec.grp1, Account, AccDesc, comment, before, minus, every AS opening, period, CASE WHEN before THEN every + period END AS outgoing "
    "FROM b JOIN spec ON Account BETWEEN lo AND hi LEFT JOIN groups ON spec.grp1 = groups.grp1) "
)


@plan(_S + f"SELECT grp2, grp1, Account, AccDesc, comment, before, minus, {_as_double('opening', 'period', 'outgoing')} FROM m WHERE period <> 0 OR (opening <> 0 AND before)")
def account_sum(spark, sf_dir):
    return _doubles(L.account_sum_printed(_account_sum(spark, sf_dir)[0]), "opening", "period", "outgoing")


_LEVEL1 = "SELECT grp2, grp1, sum(opening) AS opening, sum(CASE WHEN minus THEN -period ELSE period END) AS period FROM m GROUP BY grp2, grp1"


@plan(_S + f"SELECT grp2, grp1, {_as_double('opening', 'period')} FROM ({_LEVEL1})")
def account_sum_level1(spark, sf_dir):
    return _doubles(L.account_sum_level1(_account_sum(spark, sf_dir)[0]), "opening", "period")


@plan(_S + f"SELECT x.grp2, CAST(sum(CASE WHEN gminus THEN -x.period ELSE x.period END) AS DOUBLE) AS period FROM ({_LEVEL1}) x JOIN groups USING (grp1) GROUP BY x.grp2")
def account_sum_level2(spark, sf_dir):
    found, groups = _account_sum(spark, sf_dir)
    return _doubles(L.account_sum_level2(L.account_sum_level1(found), groups), "period")


_WITHIN = f"CAST(InvDate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
_DC = "CAST(CASE WHEN IsDebit = 1 THEN CAST(Amount AS DECIMAL(18,2)) ELSE 0 END AS DOUBLE) AS Debit, CAST(CASE WHEN IsDebit = 1 THEN 0 ELSE CAST(Amount AS DECIMAL(18,2)) END AS DOUBLE) AS Credit"
_DC_SUMS = _DC.replace("CAST(CASE", "CAST(sum(CASE").replace("END AS DOUBLE)", "END) AS DOUBLE)")


@plan(_J + f"SELECT Account, AccDesc, Act_id, InvDate, Customer, Notes, {_DC} FROM j WHERE {_WITHIN} AND Account = 1800 AND CAST(Customer AS VARCHAR) LIKE '1%'")
def account_ledger(spark, sf_dir):
    return _doubles(L.account_ledger(_lines(spark, sf_dir), START, END, 1800, "1%"), "Debit", "Credit")


@plan(_J + f"SELECT Account, {_DC_SUMS} FROM j WHERE {_WITHIN} GROUP BY Account")
def account_ledger_totals(spark, sf_dir):
    return _doubles(L.totals(L.account_ledger(_lines(spark, sf_dir), START, END), "Account"), "Debit", "Credit")


@plan(_J + f"SELECT Act_id, InvDate, Account, {_DC} FROM j WHERE {_WITHIN} AND Act_id BETWEEN 100 AND 9000")
def journal(spark, sf_dir):
    return _doubles(L.journal(_lines(spark, sf_dir), START, END, 100, 9000), "Debit", "Credit")


@plan(_J + f"SELECT Act_id, {_DC_SUMS} FROM j WHERE {_WITHIN} GROUP BY Act_id")
def journal_totals(spark, sf_dir):
    return _doubles(L.totals(L.journal(_lines(spark, sf_dir), START, END), "Act_id"), "Debit", "Credit")


@plan(f"SELECT CompId, Act_id, CAST(sum({_SIGNED}) AS DOUBLE) AS difference FROM ({_text(_LINES)}) GROUP BY CompId, Act_id HAVING sum({_SIGNED}) <> 0 OR max(abs(Amount)) = 0")
def integrity_unbalanced(spark, sf_dir):
    return _doubles(L.unbalanced(sql(spark, sf_dir, _LINES)), "difference")


@plan("SELECT * FROM customer WHERE c_custkey >= 100 AND c_custkey <= 900 AND c_mktsegment = 'BUILDING'")
def keyed_find(spark, sf_dir):
    return L.keyed_find(table(spark, sf_dir, "customer"), {"c_custkey": 100}, {"c_custkey": 900}, {"c_mktsegment": "BUILDING"})


P.both("sql_report", "SELECT * FROM {customer} ORDER BY c_nationkey, c_custkey")


@plan("SELECT n_nationkey, CASE WHEN n_nationkey + 1 <= 20 THEN n_nationkey + 1 ELSE 5 END AS next FROM nation")
def next_number(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", L.next_number(F.col("n_nationkey"), 5, 20).alias("next"))

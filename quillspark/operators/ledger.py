"""Double-entry reports over amounts, activities and accounts, each as one plan.

Tables: amount(CompId, Act_id, Account, Amount, IsDebit, Customer, Notes), activity(CompId, Act_id, InvDate, ...),
account(CompId, Account, AccDesc, IsAsset). Amounts are summed as decimals of two places, debit positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import bounded

MONEY = "decimal(18,2)"


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def signed(amount: str = "Amount", is_debit: str = "IsDebit") -> Column:
    return F.when(F.col(is_debit) == 1, _money(F.col(amount))).otherwise(-_money(F.col(amount)))


def lines(amount: DataFrame, activity: DataFrame, account: DataFrame, company: int) -> DataFrame:
    """Amounts of one company with the date of their activity and their account's text and kind."""
    mine = F.col("CompId") == company
    dates = activity.filter(mine).select("Act_id", "InvDate")
    accounts = account.filter(mine).select("Account", "AccDesc", "IsAsset")
    return amount.filter(mine).join(dates, "Act_id").join(accounts, "Account")


def account_sums(books: tuple[DataFrame, DataFrame, DataFrame], company: int, start: str, end: str, opening_of_assets_only: bool) -> DataFrame:
    """Account, AccDesc, IsAsset, opening, period of every account with a line up to `end` (amount, activity, account): both sums in one
    pass. Lines are summed by account before accounts are joined, so only the sums meet the accounts' texts."""
    amount, activity, account = books
    mine, day = F.col("CompId") == company, F.col("InvDate").cast("date")
    before, within = day < F.lit(start).cast("date"), (day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))
    dates = activity.filter(mine & (day <= F.lit(end).cast("date"))).select("Act_id", "InvDate")
    zero = F.lit(0).cast(MONEY)
    rows = amount.filter(mine).select("Act_id", "Account", signed().alias("_money")).join(dates, "Act_id").groupBy("Account")
    sums = rows.agg(F.sum(F.when(before, F.col("_money"))).alias("opening"), F.sum(F.when(within, F.col("_money"))).alias("period"), F.count_if(before).alias("_before"), F.count_if(within).alias("_within"))
    found = sums.join(account.filter(mine).select("Account", "AccDesc", "IsAsset"), "Account")
    counted = (F.col("_before") > 0) & (F.col("IsAsset") != 0) if opening_of_assets_only else F.col("_before") > 0
    found = found.filter(counted | (F.col("_within") > 0))
    return found.select("Account", "AccDesc", "IsAsset", F.coalesce(F.when(counted, F.col("opening")), zero).alias("opening"), F.coalesce("period", zero).alias("period"))


def balance(books: tuple[DataFrame, DataFrame, DataFrame], company: int, start: str, end: str) -> DataFrame:
    """Account, AccDesc, IsAsset, opening, period, outgoing, assets first and then by account: opening and outgoing for assets only;
    accounts without any sum are left out. An account that only has an opening balance has a period of 0."""
    s = account_sums(books, company, start, end, True)
    asset = F.col("IsAsset") != 0
    s = s.filter((F.col("period") != 0) | (asset & (F.col("opening") != 0)))
    return s.select("Account", "AccDesc", "IsAsset", F.when(asset, F.col("opening")).alias("opening"), "period", F.when(asset, F.col("opening") + F.col("period")).alias("outgoing")).orderBy(F.desc("IsAsset"), "Account")


def balance_subtotals(books: tuple[DataFrame, DataFrame, DataFrame], company: int, start: str, end: str) -> DataFrame:
    """is_asset (1 or 0), opening, period, outgoing: the sums of both halves of the balance, opening ones for assets only."""
    b = balance(books, company, start, end).withColumn("is_asset", F.when(F.col("IsAsset") != 0, 1).otherwise(0))
    return b.groupBy("is_asset").agg(F.sum("opening").alias("opening"), F.sum("period").alias("period"), F.sum("outgoing").alias("outgoing"))


NO_GROUP = 999_999


def account_sum(books: tuple[DataFrame, DataFrame, DataFrame], company: int, spec: DataFrame, groups: DataFrame, start: str, end: str) -> DataFrame:
    """The lines of an account-sum report: every account under every row of `spec` whose range holds it.

    spec: from, to, comment, before, minus, grp; groups: grp1, comment, minus, grp2. Returns grp2 (999999: none), grp1, Account, AccDesc,
    comment, before, minus, opening, period, outgoing (opening and outgoing where `before`). The join is by range, to a spec that is
    broadcast if it is small.
    """
    s = account_sums(books, company, start, end, False)
    spec = spec.select(F.col("from").alias("_from"), F.col("to").alias("_to"), "comment", "before", "minus", F.col("grp").alias("grp1"))
    second = groups.groupBy("grp1").agg(F.min("grp2").alias("grp2"))
    out = s.join(bounded(spec), F.col("Account").between(F.col("_from"), F.col("_to"))).join(bounded(second), "grp1", "left")
    return out.select(
        F.coalesce("grp2", F.lit(str(NO_GROUP))).alias("grp2"), "grp1", "Account", "AccDesc", "comment", "before", "minus",
        "opening", "period", F.when(F.col("before"), F.col("opening") + F.col("period")).alias("outgoing"),
    )


def account_sum_printed(found: DataFrame) -> DataFrame:
    """The lines that are shown: those with a period sum, or with an opening one where that is asked for."""
    return found.filter((F.col("period") != 0) | ((F.col("opening") != 0) & F.col("before")))


def account_sum_level1(found: DataFrame) -> DataFrame:
    """grp2, grp1, opening, period: first-level subtotals; `minus` turns the sign of the period sum only."""
    return found.groupBy("grp2", "grp1").agg(F.sum("opening").alias("opening"), F.sum(F.when(F.col("minus"), -F.col("period")).otherwise(F.col("period"))).alias("period"))


def account_sum_level2(level1: DataFrame, groups: DataFrame) -> DataFrame:
    """grp2, period: second-level subtotals, to which a first-level group whose `minus` is set adds its negative."""
    g = groups.select("grp1", F.col("minus").alias("_minus")).dropDuplicates(["grp1"])
    out = level1.join(bounded(g), "grp1")
    return out.groupBy("grp2").agg(F.sum(F.when(F.col("_minus"), -F.col("period")).otherwise(F.col("period"))).alias("period"))


def report_spec(spark, properties: str) -> tuple[DataFrame, DataFrame]:
    """Row spec and groups out of a saved report's text of lines AccountRow0Col0=... and SecondLevelRow0Col0=..."""
    p = dict(x.split("=", 1) for x in properties.splitlines() if "=" in x and not x.startswith("#"))
    get = lambda kind, n, cols: [[p.get(f"{kind}Row{i}Col{j}", "") for j in range(cols)] for i in range(n)]
    rows = [(int(a), int(b), c, d == "true", e == "true", g) for a, b, c, d, e, g in get("Account", int(p.get("AccountRows", 0)), 6) if a and b]
    groups = [(a, b, c == "true", d) for a, b, c, d in get("SecondLevel", int(p.get("SecondLevelRows", 0)), 4) if a]
    return (
        spark.createDataFrame(rows, "`from` int, `to` int, comment string, before boolean, minus boolean, grp string"),
        spark.createDataFrame(groups, "grp1 string, comment string, minus boolean, grp2 string"),
    )


def account_ledger(rows: DataFrame, start: str, end: str, account: int | None = None, customer: str | None = None) -> DataFrame:
    """Lines by account and activity with a Debit and a Credit column, and with Customer, Notes and AccDesc; `customer` is a LIKE pattern
    over the customer number."""
    day = F.col("InvDate").cast("date")
    rows = rows.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))
    if account is not None:
        rows = rows.filter(F.col("Account") == account)
    if customer is not None:
        rows = rows.filter(F.col("Customer").cast("string").like(customer))
    debit = F.col("IsDebit") == 1
    zero = F.lit(0).cast(MONEY)
    sides = F.when(debit, _money(F.col("Amount"))).otherwise(zero).alias("Debit"), F.when(debit, zero).otherwise(_money(F.col("Amount"))).alias("Credit")
    more = [c for c in ("Customer", "Notes") if c in rows.columns]
    return rows.select("Account", "AccDesc", "Act_id", "InvDate", *more, *sides).orderBy("Account", "Act_id")


def totals(found: DataFrame, by: str) -> DataFrame:
    """Debit and credit totals by account or activity, of a ledger or journal."""
    return found.groupBy(by).agg(F.sum("Debit").alias("Debit"), F.sum("Credit").alias("Credit"))


def running(found: DataFrame) -> DataFrame:
    """A ledger with `balance`, the account's running sum by activity; one account's lines are sorted in one task, so this is for one
    account or company at a time."""
    so_far = Window.partitionBy("Account").orderBy("InvDate", "Act_id", F.desc("Debit"), "Credit").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("balance", F.sum(F.col("Debit") - F.col("Credit")).over(so_far))


def journal(rows: DataFrame, start: str, end: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Lines in the order of activities, credits first within one."""
    out = account_ledger(rows, start, end)
    if first is not None:
        out = out.filter(F.col("Act_id") >= first)
    if last is not None:
        out = out.filter(F.col("Act_id") <= last)
    return out.select("Act_id", "InvDate", "Account", "Debit", "Credit").orderBy("Act_id", F.col("Debit") != 0, "Account")


def unbalanced(amount: DataFrame) -> DataFrame:
    """CompId, Act_id, difference of activities whose debits and credits differ, or that have no amount but 0."""
    s = amount.groupBy("CompId", "Act_id").agg(F.sum(signed()).alias("difference"), F.max(F.abs(_money(F.col("Amount")))).alias("_most"))
    return s.filter((F.col("difference") != 0) | (F.coalesce(F.col("_most"), F.lit(0)) == 0)).select("CompId", "Act_id", "difference")


def outside_periods(activity: DataFrame, periods: DataFrame) -> DataFrame:
    """Activities whose date is in no accounting period of their company."""
    inside = (activity["CompId"] == periods["CompId"]) & activity["InvDate"].between(periods["StartPeriod"], periods["EndPeriod"])
    return activity.join(bounded(periods), inside, "left_anti")


def keyed_find(df: DataFrame, at_least: dict | None = None, at_most: dict | None = None, equal: dict | None = None) -> DataFrame:
    """Rows that meet all conditions, ordered by all columns."""
    for given, op in ((at_least, lambda c, v: c >= v), (at_most, lambda c, v: c <= v), (equal, lambda c, v: c == v)):
        for name, value in (given or {}).items():
            df = df.filter(op(F.col(name), F.lit(value)))
    return df.orderBy(*df.columns)


def next_number(last: Column, least: int, most: int) -> Column:
    """The number after `last`; past `most`, and without a last one, it is `least`."""
    return F.when(last + 1 <= most, last + 1).otherwise(F.lit(least))


def advance_number(numbers: DataFrame, company: int, name: str, least: int, most: int) -> DataFrame:
    """`numbers` (CompId, UniqName, LastNumber) after one more number was given out; a name that is new gets a row with `least`."""
    mine = (F.col("CompId") == company) & (F.col("UniqName") == name)
    changed = numbers.withColumn("LastNumber", F.when(mine, next_number(F.col("LastNumber"), least, most)).otherwise(F.col("LastNumber")).cast("int"))
    spark = numbers.sparkSession
    new = spark.createDataFrame([(company, name, least)], "CompId int, UniqName string, LastNumber int").join(numbers.select("CompId", "UniqName"), ["CompId", "UniqName"], "left_anti")
    return changed.select("CompId", "UniqName", "LastNumber").union(new)

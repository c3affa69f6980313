import datetime
from decimal import Decimal

import pytest

from quillspark.operators import ledger as L

DAY = datetime.date


@pytest.fixture(scope="module")
def books(spark):
    account = spark.createDataFrame([(1, 1000, "cash", 1), (1, 2000, "loan", 1), (1, 3000, "sales", 0), (1, 4000, "cost", 0), (2, 1000, "other", 1)], "CompId int, Account int, AccDesc string, IsAsset int")
    activity = spark.createDataFrame([(1, 1, DAY(2019, 12, 1)), (1, 2, DAY(2020, 1, 5)), (1, 3, DAY(2020, 2, 5)), (1, 4, DAY(2021, 1, 1)), (2, 1, DAY(2020, 1, 1))], "CompId int, Act_id int, InvDate date")
    amount = spark.createDataFrame(
        [(1, 1, 1000, 500.0, 1, 7), (1, 1, 2000, 500.0, 0, 7), (1, 2, 1000, 200.0, 1, 71), (1, 2, 3000, 200.0, 0, 71), (1, 3, 4000, 80.0, 1, None), (1, 3, 1000, 80.0, 0, None),
         (1, 4, 1000, 9.0, 1, 7), (1, 4, 3000, 9.0, 0, 7), (2, 1, 1000, 10.0, 1, 7)],
        "CompId int, Act_id int, Account int, Amount double, IsDebit int, Customer int",
    )
    return amount, activity, account


def numbers(rows):
    return [tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in rows]


def test_balance(books):
    got = numbers(L.balance(books, 1, "2020-01-01", "2020-12-31").orderBy("Account").collect())
    assert got == [(1000, "cash", 1, 500, 120, 620), (2000, "loan", 1, -500, 0, -500), (3000, "sales", 0, None, -200, None), (4000, "cost", 0, None, 80, None)]
    subtotals = {r[0]: r[1:] for r in numbers(L.balance_subtotals(books, 1, "2020-01-01", "2020-12-31").collect())}
    assert subtotals == {1: (0, 120, 120), 0: (None, -120, None)}


def test_balance_shows_openings_without_any_period(books):
    got = numbers(L.balance(books, 1, "2020-06-01", "2020-06-30").orderBy("Account").collect())
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [(1000, 620, 0, 620), (2000, -500, 0, -500)]


def test_account_sum_of_a_saved_report(spark, books):
    text = (
        "AccountRows=2\nAccountRow0Col0=1000\nAccountRow0Col1=2999\nAccountRow0Col2=Balance\nAccountRow0Col3=true\nAccountRow0Col4=false\nAccountRow0Col5=10\n"
        "AccountRow1Col0=3000\nAccountRow1Col1=9999\nAccountRow1Col2=Result\nAccountRow1Col3=false\nAccountRow1Col4=true\nAccountRow1Col5=11\n"
        "SecondLevelRows=2\nSecondLevelRow0Col0=10\nSecondLevelRow0Col1=Difference\nSecondLevelRow0Col2=false\nSecondLevelRow0Col3=1\n"
        "SecondLevelRow1Col0=11\nSecondLevelRow1Col1=\nSecondLevelRow1Col2=true\nSecondLevelRow1Col3=1\n"
    )
    spec, groups = L.report_spec(spark, text)
    found = L.account_sum(books, 1, spec, groups, "2020-01-01", "2020-12-31")
    assert L.account_sum_printed(found).count() == 4
    one = L.account_sum_level1(found)
    assert {r["grp1"]: (float(r["opening"]), float(r["period"])) for r in one.collect()} == {"10": (0, 120), "11": (0, 120)}
    assert numbers(L.account_sum_level2(one, groups).collect()) == [("1", 0)]


def test_ledger_and_journal(books):
    rows = L.lines(*books, 1)
    ledger = L.account_ledger(rows, "2019-01-01", "2020-12-31", 1000)
    assert sorted((float(r["Debit"]), float(r["Credit"])) for r in ledger.collect()) == [(0, 80), (200, 0), (500, 0)]
    assert [float(r["balance"]) for r in L.running(ledger).orderBy("InvDate").collect()] == [500, 700, 620]
    assert L.account_ledger(rows, "2019-01-01", "2022-12-31", customer="7%").count() == 6
    assert [(r["Account"], r["Act_id"]) for r in L.account_ledger(rows, "2019-01-01", "2022-12-31").collect()] == [(1000, 1), (1000, 2), (1000, 3), (1000, 4), (2000, 1), (3000, 2), (3000, 4), (4000, 3)]
    assert [(r["Act_id"], r["Account"]) for r in L.journal(rows, "2019-01-01", "2020-12-31").collect()] == [(1, 2000), (1, 1000), (2, 3000), (2, 1000), (3, 1000), (3, 4000)]
    journal = L.totals(L.journal(rows, "2019-01-01", "2022-12-31", 2, 3), "Act_id")
    assert {r["Act_id"]: (float(r["Debit"]), float(r["Credit"])) for r in journal.collect()} == {2: (200, 200), 3: (80, 80)}


def test_integrity(spark, books):
    assert numbers(L.unbalanced(books[0]).collect()) == [(2, 1, 10)]
    periods = spark.createDataFrame([(1, DAY(2019, 1, 1), DAY(2020, 12, 31))], "CompId int, StartPeriod date, EndPeriod date")
    assert sorted((r["CompId"], r["Act_id"]) for r in L.outside_periods(books[1], periods).collect()) == [(1, 4), (2, 1)]


def test_numbers_wrap(spark):
    t = spark.createDataFrame([(1, "Act", 4), (1, "Cust", 9)], "CompId int, UniqName string, LastNumber int")
    assert {r["UniqName"]: r["LastNumber"] for r in L.advance_number(t, 1, "Act", 1, 9).collect()} == {"Act": 5, "Cust": 9}
    assert {r["UniqName"]: r["LastNumber"] for r in L.advance_number(t, 1, "Cust", 1, 9).collect()} == {"Act": 4, "Cust": 1}
    assert L.advance_number(t, 2, "Act", 3, 9).filter("CompId = 2").first()["LastNumber"] == 3


def test_keyed_find(books):
    assert [r["Act_id"] for r in L.keyed_find(books[1], {"Act_id": 2}, {"Act_id": 3}, {"CompId": 1}).collect()] == [2, 3]

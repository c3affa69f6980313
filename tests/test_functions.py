import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as C
from quillspark.functions import semantics as S

#: Pattern, text, whether it matches.
LIKE = [
    ("", "abc", False), ("%", "abc", True), ("a%", "abc", True), ("ab%", "abc", True), ("abc%", "abc", True), ("abcd%", "abc", False),
    ("abcd", "abc", False), ("abc", "abc", True), ("ab", "abc", False), ("a", "abc", False), ("a_", "abc", False), ("ab_", "abc", True),
    ("abc_", "abc", False), ("a_c", "abc", True), ("a%bc", "abc", True), ("a%c", "abc", True), ("%c", "abc", True), ("a_bc", "abc", False),
    ("__c", "abc", True), ("a__", "abc", True), ("a\\_\\_", "a__", True), ("a\\__", "a__", True), ("a\\__", "a_b", True),
    ("\\___", "_ab", True), ("\\_\\__", "_ab", False), ("\\_\\__", "__b", True), ("\\%ab", "%ab", True), ("ab\\%", "ab%", True),
    ("cab\\%", "cab", False), ("cab%", "cab", True),
]


def test_like(spark):
    text = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(LIKE)], "i int, t string")
    for i, (pattern, _, expected) in enumerate(LIKE):
        assert text.filter(f"i = {i}").select(S.like(F.col("t"), pattern)).first()[0] is expected, (pattern, i)
    assert spark.range(1).select(S.like(F.lit(None), "%")).first()[0] is None


@pytest.mark.parametrize("name", sorted(S.NATIVE))
def test_null_is_the_lowest_value(spark, name):
    values = [None, 1, 2]
    rank = lambda v: -1 if v is None else v
    truth = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[name]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a int, b int").withColumn("r", S.NATIVE[name](F.col("a"), F.col("b")))
    for r in df.collect():
        assert r["r"] is truth(rank(r["a"]), rank(r["b"])), r


def test_between_and_lists(spark):
    df = spark.createDataFrame([(None,), (1,), (3,), (9,)], "x int")
    out = df.select("x", S.between(F.col("x"), F.lit(1), F.lit(3)).alias("b"), S.not_between(F.col("x"), F.lit(1), F.lit(3)).alias("n"), S.in_list(F.col("x"), F.lit(None), F.lit(3)).alias("i"))
    assert [tuple(r) for r in out.collect()] == [(None, False, True, True), (1, True, False, False), (3, True, False, True), (9, False, True, False)]
    assert spark.range(1).select(S.all_of(F.lit(5), ">", F.lit(1), F.lit(4)), S.any_of(F.lit(5), "=", F.lit(1), F.lit(4))).first()[:] == (True, False)


def test_division_and_regex(spark):
    row = spark.range(1).select(S.div10(F.lit(1), F.lit(3)), S.div10(F.lit(1), F.lit(0)), S.regex_full(F.lit("a\nb"), "a.b"), S.regex_full(F.lit("A\nb"), "a.b", "is")).first()
    assert row[:] == (0.3333333333, None, False, True)


def test_line_breaks_at_the_end_count(spark):
    row = spark.range(1).select(
        S.regex_full(F.lit("abc\n"), "abc"), S.regex_full(F.lit("abc"), "x|abc"), S.regex_full(F.lit("a\nabc"), "^abc$", "m"),
        C.trim_text(F.lit("a  \n")), C.trim_text(F.lit("\n a"), side="leading"), C.trim_text(F.lit(" a ")),
    ).first()
    assert row[:] == (False, True, False, "a  \n", "\n a", "a")


def test_dates_and_times_of_now(spark):
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    row = spark.range(1).select(C.time_ob(), C.time_ob(F.lit(None).cast("string")), C.timestamp_ob(), C.timestamp_ob(F.lit(None).cast("string")), C.date_ob(F.lit("Monday, January 5, 2015")), C.date_ob(F.lit("2/3/21")), C.date_ob(F.lit("May 7, 1999"))).first()
    assert row[0].date() == row[1].date() == datetime.date(1970, 1, 1) and all(abs((x - now).total_seconds()) < 120 for x in row[2:4])
    assert row[4:] == (datetime.date(2015, 1, 5), datetime.date(2021, 2, 3), datetime.date(1999, 5, 7))


@pytest.mark.parametrize(
    "begin, end, expected", [(0, 2, "ab"), (2, 4, "cd"), (-5, 2, "ab"), (3, 3, ""), (4, 2, ""), (9, None, ""), (3, None, "def"), (3, 99, "def"), (5, 6, "f")]
)
def test_substring_counts_from_zero_to_an_end(spark, begin, end, expected):
    assert spark.range(1).select(C.substring0(F.lit("abcdef"), begin, end)).first()[0] == expected


def test_text_functions(spark):
    row = spark.range(1).select(
        C.substring0(F.lit(None).cast("string"), 0, 1), C.trim_text(F.lit("ababxab"), "ab"), C.trim_text(F.lit("xxa"), "x", "trailing"),
        C.binary_to_hex(F.lit(b"\x0a\xff")), C.hex_to_binary(F.lit("abc")), C.to_number(F.lit("12.5")), C.to_number(F.lit("no")), C.to_number(F.lit(None)),
    ).first()
    assert row[:] == (None, "x", "xxa", "0aff", bytearray(b"\x0a\xbc"), 12.5, 0.0, None)


def test_number_functions(spark):
    row = spark.range(1).select(
        C.least_native(F.lit(3), F.lit(None)), C.least_native(F.lit(3), F.lit(2)), C.sqrt_native(F.lit(-1.0)), C.sqrt_native(F.lit(9.0)),
        C.if_native(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)), C.if_native(F.lit(False), F.lit(1), F.lit(2)),
        C.to_number(F.lit(True), "boolean"), C.to_number(F.lit(datetime.date(1970, 1, 2)), "date"),
    ).first()
    assert row[:] == (None, 2, None, 3.0, None, 2, 1.0, 86400000.0)


def test_date_functions(spark):
    row = spark.range(1).select(
        C.date_ob(F.lit("2020-02-03")), C.date_ob(F.lit(86_400_000), "number"), C.date_ob(F.lit("junk")), C.time_ob(F.lit("01:02:03")), C.timestamp_ob(F.lit("2020-02-03 01:02:03.5")),
    ).first()
    assert row[:3] == (datetime.date(2020, 2, 3), datetime.date(1970, 1, 2), None)
    assert row[3:] == (datetime.datetime(1970, 1, 1, 1, 2, 3), datetime.datetime(2020, 2, 3, 1, 2, 3, 500000))


def test_catalog_texts(spark):
    t = lambda size, scale: C.sql_type_text(F.lit("DECIMAL"), F.lit(size).cast("int"), F.lit(scale).cast("int"))
    assert spark.range(1).select(t(None, None), t(5, -1), t(5, 2)).first()[:] == ("DECIMAL", "DECIMAL(5)", "DECIMAL(5,2)")
    assert spark.range(1).select(C.fk_rule_code(F.lit(None)), C.fk_rule_code(F.lit("CASCADE")), C.fk_rule_code(F.lit("SET DEFAULT"))).first()[:] == (3, 0, 4)

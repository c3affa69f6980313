import pytest
from pyspark.sql import functions as F

from quillspark.functions.semantics import NATIVE
from quillspark.functions.udfs import fold
from quillspark.operators import changes as D
from quillspark.operators import constraints as K
from quillspark.operators import relational as R
from quillspark.sources import catalog as C
from quillspark.sources import tables as T
from quillspark.sources.shared import shared_dir
from quillspark.streaming.triggers import on_insert

OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
SETS = ([], [2], [1, 3], [None], [2, None], [2, 2], [1, 2, None])


@pytest.mark.parametrize("op", sorted(OPS))
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
def test_quantified_subqueries(spark, op, quantifier):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int")
    for values in SETS:
        s = spark.createDataFrame([(v,) for v in values], "v int")
        got = sorted((r["x"] for r in R.quantified(df, "x", op, quantifier, s, "v").collect()), key=str)
        ansi = []
        for x in (None, 1, 2, 3):
            each = [None if x is None or v is None else OPS[op](x, v) for v in values]
            ansi.append(any(each) if quantifier == "ANY" else all(e is True for e in each))
        assert got == sorted((x for x, y in zip((None, 1, 2, 3), ansi) if y), key=str), values
        got = sorted((r["x"] for r in R.quantified(df, "x", op, quantifier, s, "v", native=True).collect()), key=str)
        low = lambda v: -1 if v is None else v
        every = [(any if quantifier == "ANY" else all)(OPS[op](low(x), low(v)) for v in values) and bool(values) for x in (None, 1, 2, 3)]
        assert got == sorted((x for x, y in zip((None, 1, 2, 3), every) if y), key=str), ("native", values)


def test_null_keys_match(spark):
    a, b = spark.createDataFrame([(None, "a"), (1, "b")], "k int, x string"), spark.createDataFrame([(None, "c"), (2, "d")], "k int, y string")
    assert [tuple(r) for r in R.join_null_keys(a, b, [("k", "k")]).select("x", "y").collect()] == [("a", "c")]


def test_groups_with_one_row(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 4, None), (None, 5, 1)], "k string, i int, v int")
    assert sorted(map(str, (r["i"] for r in R.group_max(df, ["k"], "v", ["i"]).collect()))) == ["2", "4", "5"]
    assert sorted(r["i"] for r in R.first_row(df, ["k"], ["i"]).collect()) == [1, 4, 5]


def test_native_aggregates(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 3)], "i int, v int")
    row = df.agg(R.avg_native(F.col("v")), R.min_native(F.col("v")), R.sum_native(F.col("v"), F.col("i")), R.sum_native(F.col("v"), -F.col("i")), R.count_distinct_native(F.col("v"))).first()
    assert row[:] == (2.0, None, None, 6, 2)


def test_numbers_and_pages(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    assert all(r["n"] == r["x"] + 1 for r in R.numbered(df, ["x"], "n").collect())
    assert [r["x"] for r in R.page(df, ["x"], 10, 3).collect()] == [10, 11, 12]
    assert sorted(tuple(r) for r in R.zip_columns(spark.range(3).toDF("a"), spark.range(5, 10).toDF("b"), ["a"], ["b"]).collect()) == [(0, 5), (1, 6), (2, 7)]
    with pytest.raises(ValueError):
        R.orderable(spark.sql("SELECT binary('a') AS b"), ["b"])


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert rows(D.insert_values(df, [(4,)], ["i"], {"s": "new"})) == [(1, "a"), (2, None), (3, "c"), (4, "new")]
    assert rows(D.insert_values(df, [])) == rows(df)
    assert rows(D.insert_set(df, i="7")) == [(1, "a"), (2, None), (3, "c"), (7, None)]
    assert rows(D.update(df, F.col("s") > "a", {"s": F.upper("s"), "i": F.col("i") + 10})) == [(1, "a"), (13, "C"), (2, None)]
    assert rows(D.update(df, F.col("i") > 0, {"s": F.lit("x")}, 2, ["i"])) == [(1, "x"), (2, "x"), (3, "c")]
    assert rows(D.delete(df, F.col("s") == "a")) == [(2, None), (3, "c")]
    assert rows(D.delete(df, F.col("i") > 1, 1, ["i"])) == [(1, "a"), (3, "c")]


def test_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    t = K.Table("t", (("id", "int"), ("ref", "int"), ("n", "int")), ("n",), ("id",), (("ref",),), (("positive", "n > 0"),), ((("ref",), "p", ("id",)),))
    good = spark.createDataFrame([(1, 1, 1), (2, None, 3)], t.schema())
    assert t.violations(good, {"p": parent}).count() == 0
    bad = spark.createDataFrame([(1, 1, -1), (1, 5, None), (None, 5, 2)], t.schema())
    assert {r["rule"]: r["n"] for r in t.violations(bad, {"p": parent}).collect()} == {
        "NOT NULL id": 1, "NOT NULL n": 1, "UNIQUE id": 1, "UNIQUE ref": 1, "CHECK positive": 1, "FOREIGN KEY ref": 2,
    }
    assert t.empty(spark).columns == ["id", "ref", "n"]


def test_altered_definitions(spark):
    t = K.Table("t", (("id", "int"),), primary_key=("id",), checks=(("c", "id > 0"),)).add_column("s", "string", "x").set_default("id", 5)
    df = t.fitted(spark.createDataFrame([(1, 2)], "id long, gone int"))
    assert [tuple(r) for r in df.collect()] == [(1, "x")] and df.dtypes == [("id", "int"), ("s", "string")]
    assert t.drop_column("s").columns == (("id", "int"),) and t.drop_primary_key().primary_key == () and t.drop_check("c").checks == ()
    assert t.set_default("s", None).defaults == {"id": 5}


def test_backup_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "CompId int, s string")
    T.backup(df, f"{tmp_path}/b", 2)
    assert [tuple(r) for r in T.restore(spark, f"{tmp_path}/b").collect()] == [(2, "b")]
    into = spark.createDataFrame([], "s string, extra int, CompId long")
    assert [tuple(r) for r in T.restore(spark, f"{tmp_path}/b", into).collect()] == [("b", None, 2)]


def test_scripts(spark):
    out = T.run_script(spark, "/root/testdata/sf0.001", "-- two statements\nSELECT count(*) AS n FROM {region};\nSELECT 1 AS x;\n")
    assert [d.first()[0] for d in out] == [5, 1]


def test_rows_at_the_ends(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "c")], "i int, s string")
    assert df.agg(R.end_value("s", "i"), R.end_value("s", "i", last=True), R.single_value("s")).first()[:] == (None, "c", None)
    assert df.filter("i > 1").agg(R.single_value("s")).first()[0] == "c"
    assert sorted(r["i"] for r in R.rest(df, ["i"]).collect()) == [2, 3]


def test_catalog(spark, tmp_path):
    t = K.Table("quill_catalog_test", (("id", "int"), ("s", "string")), primary_key=("id",))
    C.drop(spark, t.name, if_exists=True)
    assert C.create(spark, t, temporary=True).dtypes == [("id", "int"), ("s", "string")]
    assert t.name in {r["table_name"] for r in C.show_tables(spark).collect()}
    C.drop(spark, t.name)
    assert t.name not in {r["table_name"] for r in C.show_tables(spark).collect()}
    assert [r["column_name"] for r in C.describe(t.empty(spark)).collect()] == ["id", "s"]
    C.commit(spark.createDataFrame([(1, "a")], "id int, s string"), t, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    with pytest.raises(C.Violated, match="UNIQUE id"):
        C.commit(spark.createDataFrame([(1, "a"), (1, "b")], "id int, s string"), t, f"{tmp_path}/u")
    assert {r["type_name"] for r in C.show_types(spark).collect()} == set(C.TYPES)
    assert all(spark.range(1).selectExpr(f"CAST(NULL AS {k}) AS x").count() for k in C.TYPES.values())


def test_definitions_keep_their_constraints(spark):
    t = K.Table("quill_kept_test", (("id", "int"), ("s", "string"), ("n", "int")), ("n",), ("id",), (("s", "n"),), (("it's", "n > 0 AND s <> '\\\\'"),), ((("n",), "p", ("id",), "SET NULL"),), {"s": "a'b"})
    assert K.Table.from_json(t.to_json()) == t
    C.drop(spark, t.name, if_exists=True)
    C.create(spark, t)
    assert C.definition(spark, t.name) == t
    spark.createDataFrame([(1, "x", 2), (2, "y", 3)], t.schema()).write.mode("append").saveAsTable(t.name)
    with pytest.raises(C.Violated, match="CHECK most"):
        C.alter(spark, t.name, lambda d: d.drop_foreign_key("n").add_check("most", "n < 3"))
    assert C.definition(spark, t.name) == t and spark.table(t.name).count() == 2
    out = C.alter(spark, t.name, lambda d: d.drop_column("n").add_column("m", "bigint", 7).add_unique("m", "id").drop_primary_key().add_primary_key("id"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", 7), (2, "y", 7)]
    held = C.definition(spark, t.name)
    assert held.checks == held.foreign_keys == held.not_null == () and held.unique == (("m", "id"),) and held.primary_key == ("id",)
    C.drop(spark, t.name)
    with pytest.raises(ValueError):
        K.Table("t", (("a", "int"),), primary_key=("b",))
    with pytest.raises(ValueError):
        held.add_primary_key("m")


def test_rules_on_delete(spark):
    child, gone = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, ref int"), spark.createDataFrame([(5,), (5,)], "k int")
    rows = lambda rule: sorted(tuple(r) for r in K.on_delete(child, ["ref"], gone, ["k"], rule, {"ref": 9}).collect())
    assert rows("CASCADE") == [(2, 6), (3, None)] and rows("SET NULL") == [(1, None), (2, 6), (3, None)]
    assert rows("SET DEFAULT") == [(1, 9), (2, 6), (3, None)] and rows("NO ACTION") == rows("RESTRICT") == [(1, 5), (2, 6), (3, None)]
    with pytest.raises(ValueError):
        rows("DROP")


def test_schemas(spark):
    C.drop_schema(spark, "quill_schema_test", if_exists=True, cascade=True)
    C.create_schema(spark, "quill_schema_test")
    C.create_schema(spark, "quill_schema_test", if_not_exists=True)
    before = spark.catalog.currentDatabase()
    C.set_schema(spark, "quill_schema_test")
    assert spark.catalog.currentDatabase() == "quill_schema_test" and "quill_schema_test" in {r["schema_name"] for r in C.show_schemas(spark).collect()}
    C.set_schema(spark, before)
    C.drop_schema(spark, "quill_schema_test")


def test_text_of_results(spark):
    df = spark.createDataFrame([(10, "ab"), (2, None)], "id int, s string")
    assert [r["line"] for r in T.as_text(df, ["id"]).orderBy("n").collect()] == ["id | s   ", "---+-----", "2  | NULL", "10 | ab  "]


def test_shared_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_user_aggregates(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(50)] + [("b", 1, None), (None, 2, 7)], "k string, i int, v int").repartition(5)
    step = lambda a, v: a + [v] if v is not None else a
    out = fold(df, ["k"], "v", [], step, lambda a, b: a + b, lambda a: sum(a) if a else None, "bigint", "total")
    assert {r["k"]: r["total"] for r in out.collect()} == {"a": sum(i * i for i in range(50)), "b": None, None: 7}


def test_triggers(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    told = []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    on_insert(stream, "t", lambda *x: told.append(x), f"{tmp_path}/at", f"{tmp_path}/out").awaitTermination(60)
    assert told == [("t", "INSERT", 5)] and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_native_comparisons_are_complete():
    assert set(NATIVE) == set(OPS)

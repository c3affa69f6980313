import pytest

import __spark_entry__
from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(name, agree):
    agree(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_has_rows(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["gt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "o_orderstatus" not in plan


def test_balance_reads_lines_once_and_uses_no_python(spark):
    plan = registry.QUERIES["balance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.count("FileScan parquet [l_orderkey") == 1
    assert "Python" not in plan and "Cartesian" not in plan


def test_unique_keys_are_consecutive(spark):
    keys = [r["unique_key"] for r in registry.QUERIES["unique_key"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(keys) == list(range(1, len(keys) + 1))


def test_joins_run_over_whole_tables(spark):
    """Every line joins itself; of orders and customers that are chosen by value, each is in the result, some without the other."""
    count = lambda name, some="true": spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").filter(some).count()
    line = ["l_orderkey", "l_linenumber"]
    assert registry.QUERIES["equi2"](spark, "/root/testdata/sf0.001").select(*line).distinct().count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*line).distinct().count()
    both = registry.QUERIES["full_outer"](spark, "/root/testdata/sf0.001")
    assert both.filter("o_orderkey IS NOT NULL").count() == count("orders", "o_orderstatus = 'F' AND o_totalprice > 200000")
    assert both.select("c_custkey").distinct().filter("c_custkey IS NOT NULL").count() == count("customer", "c_mktsegment = 'BUILDING'")
    assert not both.filter("c_custkey IS NULL").isEmpty() and not both.filter("o_orderkey IS NULL").isEmpty()

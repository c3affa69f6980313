from __future__ import annotations

import glob
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the smallest tables as views."""
    import duckdb

    if not os.path.isdir(TINY):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for path in glob.glob(f"{TINY}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def rows_by_column(rows, columns):
    """Rows as tuples in the order of column names, sorted: what two engines must agree on."""
    order = sorted(columns)
    return sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Compares a query with its DuckDB text."""
    def check(query, text):
        df = query(spark, TINY)
        relation = duck.sql(text)
        assert sorted(df.columns) == sorted(relation.columns)
        assert rows_by_column([tuple(r) for r in df.collect()], df.columns) == rows_by_column(relation.fetchall(), relation.columns)

    return check

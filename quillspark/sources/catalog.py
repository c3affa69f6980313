"""SHOW and DESCRIBE as DataFrames, and tables made, altered and dropped in Spark's catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.constraints import Table
from quillspark.sources.shared import drop_kept, keep

#: SQL type names and the Spark type that holds them.
TYPES = {
    "BIT": "boolean", "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint",
    "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "NUMERIC": "decimal(38,18)", "DECIMAL": "decimal(38,18)",
    "CHAR": "string", "VARCHAR": "string", "LONGVARCHAR": "string", "STRING": "string", "TEXT": "string",
    "DATE": "date", "TIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
    "BINARY": "binary", "VARBINARY": "binary", "LONGVARBINARY": "binary", "BLOB": "binary",
}


def show_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").toDF("schema_name")


def show_tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """schema_name, table_name, temporary."""
    return spark.sql(f"SHOW TABLES IN `{schema}`" if schema else "SHOW TABLES").toDF("schema_name", "table_name", "temporary")


def show_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPES.items()), "type_name string, spark_type string")


def show_product(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("name", "quillspark on Apache Spark"), ("version", spark.version)], "var string, value string")


def show_connection(spark: SparkSession) -> DataFrame:
    """The session's user, schema, time zone and mode of comparison."""
    rows = [("user", spark.sql("SELECT current_user()").first()[0]), ("current_schema", spark.catalog.currentDatabase())]
    rows += [(k, spark.conf.get(k, None)) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")]
    return spark.createDataFrame(rows, "var string, value string")


def show_status(spark: SparkSession) -> DataFrame:
    """What is cached and how many tasks run at once."""
    context = spark.sparkContext
    rows = [("application", context.applicationId), ("parallel_tasks", str(context.defaultParallelism)), ("shuffle_partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame(rows, "var string, value string")


def describe(df: DataFrame) -> DataFrame:
    """position, column_name, data_type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


#: The table property that holds a definition.
DEFINITION = "quillspark.definition"


def create(spark: SparkSession, table: Table, if_not_exists: bool = False, temporary: bool = False) -> DataFrame:
    """An empty table of this definition in the catalog, or a view of this session (which keeps no more than the columns). The catalog
    keeps the whole definition as a table property."""
    if temporary:
        table.empty(spark).createOrReplaceTempView(table.name)
    elif not (if_not_exists and spark.catalog.tableExists(table.name)):
        _written(table.empty(spark), table, "errorifexists")
    return spark.table(table.name)


def _written(rows: DataFrame, table: Table, mode: str) -> None:
    rows.write.mode(mode).saveAsTable(table.name)
    text = table.to_json().replace("\\", "\\\\").replace("'", "\\'")
    rows.sparkSession.sql(f"ALTER TABLE {table.name} SET TBLPROPERTIES ('{DEFINITION}' = '{text}')")


def definition(spark: SparkSession, name: str) -> Table:
    """The definition that create() or alter() stored; of another table, its columns."""
    held = {} if any(t.isTemporary and t.name == name for t in spark.catalog.listTables()) else {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if DEFINITION in held:
        return Table.from_json(held[DEFINITION])
    return Table(name, tuple((f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields))


def alter(spark: SparkSession, name: str, change: Callable[[Table], Table], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Change a stored table's definition and its rows with it; raises, and changes nothing, if the rows violate the new one."""
    new = change(definition(spark, name))
    rows = keep(new.fitted(spark.table(name)), "altered")  # a table can't be read while it is replaced
    _check(rows, new, parents)
    _written(rows, new, "overwrite")
    spark.catalog.refreshTable(name)
    drop_kept(rows)
    return spark.table(name)


def create_schema(spark: SparkSession, name: str, if_not_exists: bool = False) -> None:
    spark.sql(f"CREATE SCHEMA {'IF NOT EXISTS ' if if_not_exists else ''}`{name}`")


def drop_schema(spark: SparkSession, name: str, if_exists: bool = False, cascade: bool = False) -> None:
    """A schema with tables is dropped with `cascade` only."""
    spark.sql(f"DROP SCHEMA {'IF EXISTS ' if if_exists else ''}`{name}` {'CASCADE' if cascade else 'RESTRICT'}")


def set_schema(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def show_table_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("TABLE",), ("TEMPORARY",), ("VIEW",)], "table_type string")


def show_keys(spark: SparkSession, *tables: Table) -> DataFrame:
    """table_name, key_type (PRIMARY, UNIQUE, FOREIGN), key_seq (from 1), column_name, parent_name, parent_column, delete_rule of every
    column of every key."""
    rows = []
    for t in tables:
        rows += [(t.name, "PRIMARY", i, c, None, None, None) for i, c in enumerate(t.primary_key, 1)]
        rows += [(t.name, "UNIQUE", i, c, None, None, None) for u in t.unique for i, c in enumerate(u, 1)]
        for columns, parent, parent_columns, *rule in t.foreign_keys:
            rows += [(t.name, "FOREIGN", i, c, parent, p, rule[0] if rule else "NO ACTION") for i, (c, p) in enumerate(zip(columns, parent_columns), 1)]
    return spark.createDataFrame(rows, "table_name string, key_type string, key_seq int, column_name string, parent_name string, parent_column string, delete_rule string")


def drop(spark: SparkSession, *names: str, if_exists: bool = False) -> None:
    for name in names:
        if not spark.catalog.dropTempView(name):
            spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")


class Violated(ValueError):
    """Rows break a table's constraints; nothing has been written."""


def _check(rows: DataFrame, table: Table, parents: dict[str, DataFrame] | None) -> None:
    broken = [f"{r['rule']} ({r['n']})" for r in table.violations(rows, parents).collect()]  # one row for each rule at most
    if broken:
        raise Violated(f"{table.name}: {', '.join(broken)}")


def commit(df: DataFrame, table: Table, path: str, parents: dict[str, DataFrame] | None = None) -> None:
    """Write the table's new rows as Parquet once none of its constraints is violated."""
    rows = table.fitted(df)
    _check(rows, table, parents)
    rows.write.mode("errorifexists").parquet(path)

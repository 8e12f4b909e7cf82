"""Read tables, file sets and warehouses as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, ref: str) -> DataFrame:
    """A catalog table or view, or a file path in a format Spark knows by its ending."""
    for ending, form in ((".parquet", "parquet"), (".orc", "orc"), (".json", "json"), (".csv", "csv")):
        if ref.endswith(ending):
            reader = spark.read.option("header", "true") if form == "csv" else spark.read
            return reader.format(form).load(ref)
    return spark.table(ref)


def scan_files(spark: SparkSession, paths: Sequence[str], merge_schema: bool = False) -> DataFrame:
    """One table from many Parquet files."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of a folder's Parquet tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def preview(df: DataFrame, order: Sequence[str], n: int = 200) -> DataFrame:
    """The first ``n`` rows in a stable order."""
    return df.orderBy(*order).limit(n)


@dataclass(frozen=True)
class Warehouse:
    """How Spark reaches a kind of warehouse."""

    form: str
    driver: str | None = None
    read_only: str | None = None


# Driver classes and read-only statements of the supported warehouses.
WAREHOUSES: Mapping[str, Warehouse] = {
    "sqlite": Warehouse("jdbc", "org.sqlite.JDBC", "PRAGMA query_only = ON"),
    "duckdb": Warehouse("jdbc", "org.duckdb.DuckDBDriver", None),
    "postgresql": Warehouse("jdbc", "org.postgresql.Driver", "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"),
    "mysql": Warehouse("jdbc", "com.mysql.cj.jdbc.Driver", "SET SESSION TRANSACTION READ ONLY"),
    "mssql": Warehouse("jdbc", "com.microsoft.sqlserver.jdbc.SQLServerDriver", None),
    "trino": Warehouse("jdbc", "io.trino.jdbc.TrinoDriver", None),
    "clickhouse": Warehouse("jdbc", "com.clickhouse.jdbc.ClickHouseDriver", "SET readonly = 1"),
    "snowflake": Warehouse("snowflake"),
    "bigquery": Warehouse("bigquery"),
    "derby": Warehouse("jdbc", "org.apache.derby.jdbc.EmbeddedDriver", None),
}


@dataclass(frozen=True)
class Partitioning:
    """Split a warehouse read by ranges of a numeric or date column."""

    column: str
    lower: str
    upper: str
    parts: int


def source_options(
    kind: str, url: str, *, table: str | None = None, query: str | None = None, split: Partitioning | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    """Reader options of a warehouse table or query."""
    if kind not in WAREHOUSES:
        raise ValueError(f"unknown source {kind!r}")
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    warehouse = WAREHOUSES[kind]
    options: dict[str, str] = {"url": url}
    # A split read needs dbtable, so a query goes in as a derived table.
    if table is not None:
        options["dbtable"] = table
    elif split is not None:
        options["dbtable"] = f"({query}) q"
    else:
        options["query"] = query
    if warehouse.form == "jdbc":
        options["fetchsize"] = str(fetch_size)
        if warehouse.driver:
            options["driver"] = warehouse.driver
        if warehouse.read_only:
            options["sessionInitStatement"] = warehouse.read_only
        if split is not None:
            options |= {
                "partitionColumn": split.column,
                "lowerBound": split.lower,
                "upperBound": split.upper,
                "numPartitions": str(split.parts),
            }
    return options


def read_source(spark: SparkSession, kind: str, url: str, **how: object) -> DataFrame:
    """A warehouse table or query; Spark pushes filters, columns and simple aggregates into it."""
    return spark.read.format(WAREHOUSES[kind].form if kind in WAREHOUSES else "jdbc").options(**source_options(kind, url, **how)).load()


def with_event_time(df: DataFrame, column: str) -> DataFrame:
    """Cast a zone-less timestamp to the type watermarks accept."""
    return df.withColumn(column, F.col(column).cast("timestamp"))

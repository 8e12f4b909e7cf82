"""Compare a Spark result with its SQL twin: column names, row count, values and value types."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def cell(value: object) -> object:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"f:{value + 0.0!r}"
    if isinstance(value, decimal.Decimal):
        return f"d:{value}"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, datetime.datetime):
        return f"t:{value.isoformat()}"
    return f"{type(value).__name__}:{value}"


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    table = df.select(*[f"`{n}`" for n in names]).toArrow()
    return names, sorted(tuple(cell(v) for v in row) for row in zip(*[c.to_pylist() for c in table.columns], strict=True)) if table.num_rows else []


def sql_rows(con: duckdb.DuckDBPyConnection, text: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(text)
    raw = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    index = sorted(range(len(raw)), key=lambda i: raw[i])
    return [raw[i] for i in index], sorted(tuple(cell(r[i]) for i in index) for r in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, text: str) -> str | None:
    """None where equal, else what differs."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, text)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if len(ours) != len(theirs):
        only = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows vs {len(theirs)}: {only}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"{names}\n  spark {a}\n  sql   {b}"
    return None

"""Ad-hoc SQL: read-only, parameterised, capped; and batches of named panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.spec import CheckSpec, register_check
from plumbline.session import cut_lineage

PANEL_ROWS = 500


def run_select(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None, limit: int = 200) -> DataFrame:
    """A query as a subquery under a limit.

    Only a query fits there, so statements that write or define do not parse. Values go in as named
    parameters, never as text. One row more than ``limit`` is asked for, and ``truncated`` says of every row
    whether the query had more.
    """
    body = text.strip().rstrip(";")
    rows = spark.sql(f"SELECT * FROM (\n{body}\n) LIMIT {int(limit) + 1}", args=dict(args or {}))
    # The limit leaves its rows in one partition, in the query's order.
    in_order = Window.orderBy(F.monotonically_increasing_id())
    numbered = rows.select("*", F.row_number().over(in_order).alias("_nth"), (F.count(F.lit(1)).over(Window.partitionBy()) > limit).alias("truncated"))
    return numbered.filter(F.col("_nth") <= limit).drop("_nth")


@dataclass(frozen=True)
class Panel:
    title: str
    sql: str


def run_panels(spark: SparkSession, panels: Sequence[Panel], limit: int = PANEL_ROWS) -> DataFrame:
    """``(panel, title, row, truncated, error)`` of every panel; one that fails becomes a row with its error.

    Each panel is a Spark job of its own and at most ``limit`` rows long.
    """
    schema = "panel int, title string, row string, truncated boolean, error string"
    out = spark.createDataFrame([], schema)
    for i, panel in enumerate(panels):
        try:
            rows = run_select(spark, panel.sql, limit=limit)
            part = cut_lineage(rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns[:-1]])).alias("row"), "truncated"))
            part = part.select(F.lit(i).alias("panel"), F.lit(panel.title).alias("title"), "row", "truncated", F.lit(None).cast("string").alias("error"))
        except PySparkException as failure:
            why = f"{type(failure).__name__}: {failure.getCondition()}"
            part = spark.createDataFrame([(i, panel.title, None, None, why)], schema)
        out = out.unionByName(part)
    return out


def heuristic_panels(table: str, facts: DataFrame, distinct: DataFrame) -> list[Panel]:
    """Starter panels of a table from its profile (one small row per column)."""
    columns = [r.asDict() for r in facts.join(distinct, "column_name", "left").orderBy("ordinal").collect()]
    panels = [Panel("Total rows", f"SELECT count(*) AS total_rows FROM {table}")]
    clock = next((c["column_name"] for c in columns if c["max_ts"] is not None), None)
    if clock:
        panels.append(Panel("Rows per day", f"SELECT to_date(`{clock}`) AS day, count(*) AS n FROM {table} GROUP BY 1 ORDER BY 1 DESC LIMIT 45"))
    small = sorted((c for c in columns if c["kind"] == "string" and 2 <= (c["distinct_count"] or 0) <= 20), key=lambda c: c["distinct_count"])
    for c in small[:2]:
        name = c["column_name"]
        panels.append(Panel(f"Rows by {name}", f"SELECT `{name}` AS value, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12"))
    numeric = [c for c in columns if c["kind"] == "numeric" and c["stddev"] and c["max_number"] > c["min_number"]]
    if numeric:
        c = max(numeric, key=lambda c: c["distinct_count"] or 0)
        width = (c["max_number"] - c["min_number"]) / 30
        width = round(width, 6) if width < 1 else round(width)
        name = c["column_name"]
        panels.append(
            Panel(
                f"Distribution of {name}",
                f"SELECT round(`{name}` / {width}) * {width} AS bucket, count(*) AS n FROM {table} WHERE `{name}` IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 80",
            )
        )
    gaps = [c for c in columns if (c["null_pct"] or 0) > 0]
    if gaps:
        name = max(gaps, key=lambda c: c["null_pct"])["column_name"]
        panels.append(Panel(f"Rows missing {name}", f"SELECT count(*) AS null_rows FROM {table} WHERE `{name}` IS NULL"))
    return panels[:6]


def sql_violations(df: DataFrame, spec: CheckSpec, history: DataFrame | None = None) -> DataFrame:
    """The rows a SQL rule returns. The checked table is visible to it as ``source``."""
    body = spec.params["sql"].strip().rstrip(";")
    # The name is the rule's alone: no session view is replaced.
    return df.sparkSession.sql(f"WITH source AS (SELECT * FROM {{checked_rows}}) SELECT * FROM (\n{body}\n)", args=dict(spec.params.get("args") or {}), checked_rows=df)


register_check("custom_sql", sql_violations, needs_column=False, required=("sql",))

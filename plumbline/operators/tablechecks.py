"""Checks whose answer needs the whole table: uniqueness, freshness, volume, SQL rules and cross-table rules."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rowchecks import count_where


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once, with their row counts."""
    return (
        df.select(F.col(f"`{column}`").alias(column))
        .filter(F.col(f"`{column}`").isNotNull())
        .groupBy(F.col(f"`{column}`"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def unique_counts(df: DataFrame, column: str) -> DataFrame:
    """Surplus rows, duplicate groups, duplicated rows and rows evaluated, in one row.

    Copies of a value are combined on the map side, so a value held by a third of all rows reaches its
    reducer as one partial count per task.
    """
    counted = df.groupBy(F.col(f"`{column}`").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    dup = F.col("_value").isNotNull() & (F.col("_n") > 1)
    rows = F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0))
    groups = count_where(dup)
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_evaluated"),
        groups.alias("duplicate_groups"),
        rows.alias("duplicated_rows"),
        (rows - groups).alias("violation_count"),
    )


def duplicate_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows whose value occurs more than once."""
    return df.join(duplicate_groups(df, column).select(F.col(f"`{column}`").alias("_value")), F.col(f"`{column}`") == F.col("_value"), "left_semi")


def _dictionary(allowed: DataFrame, case_sensitive: bool) -> DataFrame:
    value = F.col(f"`{allowed.columns[0]}`")
    return allowed.select((value if case_sensitive else F.lower(value.cast("string"))).alias("_value")).distinct()


def member_counts(df: DataFrame, column: str, allowed: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Rows whose value is in no row of ``allowed`` (its first column), and rows evaluated, in one row.

    The column shrinks to its distinct values before the join, on the map side first, so a value held by a third of all
    rows is one row; which side is broadcast, if any, the planner decides by size.
    """
    value = F.col(f"`{column}`")
    counted = df.groupBy((value if case_sensitive else F.lower(value.cast("string"))).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    known = _dictionary(allowed, case_sensitive).withColumn("_known", F.lit(True))
    judged = counted.join(known, "_value", "left")
    unknown = F.col("_value").isNotNull() & F.col("_known").isNull()
    return judged.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_evaluated"), F.coalesce(F.sum(F.when(unknown, F.col("_n"))), F.lit(0)).alias("violation_count"))


def strangers(df: DataFrame, column: str, allowed: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """The rows behind ``member_counts``. NULL is no stranger."""
    value = F.col(f"`{column}`")
    kept = df.filter(value.isNotNull())
    known = _dictionary(allowed, case_sensitive)
    return kept.join(known, (value if case_sensitive else F.lower(value.cast("string"))) == F.col("_value"), "left_anti")


def duplicate_samples(df: DataFrame, column: str, groups: int = 10) -> DataFrame:
    """All rows of the most duplicated values."""
    top = duplicate_groups(df, column).orderBy(F.desc("occurrences"), F.asc(f"`{column}`")).limit(groups)
    # `groups` rows at most, whatever the table holds: safe to broadcast, and it spares the table a shuffle.
    return df.join(F.broadcast(top.select(column)), column, "left_semi")


def freshness(df: DataFrame, column: str, as_of: datetime, max_age_hours: float | Column) -> DataFrame:
    """Age of the newest non-future value against a limit; one row."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stamp = F.col(f"`{column}`").cast("timestamp_ntz")
    seen = df.agg(
        F.max(F.when(stamp <= now, stamp)).alias("latest"),
        count_where(stamp > now).alias("future_rows"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return freshness_of(seen, now, max_age_hours)


def freshness_of(seen: DataFrame, now: Column, max_age_hours: float | Column) -> DataFrame:
    """Judge rows that already carry ``latest`` and ``future_rows``."""
    limit = max_age_hours if isinstance(max_age_hours, Column) else F.lit(float(max_age_hours))
    age = F.timestamp_diff("SECOND", F.col("latest"), now) / F.lit(3600.0)
    return seen.select(
        *seen.columns,
        F.round(age, 2).alias("age_hours"),
        limit.alias("max_age_hours"),
        F.when(F.col("latest").isNull() | (age > limit), 1).otherwise(0).cast("bigint").alias("violation_count"),
    )


def row_count_min(df: DataFrame, min_rows: int) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("rows_evaluated"))
    return counted.select(
        "rows_evaluated", F.when(F.col("rows_evaluated") < min_rows, 1).otherwise(0).cast("bigint").alias("violation_count")
    )


def order_totals_mismatch(
    headers: DataFrame, lines: DataFrame, key: str, line_key: str, total: str, amount: Column, tolerance: float = 0.01
) -> DataFrame:
    """Headers whose total differs from the sum of their lines. Lines are summed before the join."""
    sums = lines.groupBy(F.col(line_key).alias(key)).agg(F.sum(amount).alias("lines_total"))
    return (
        headers.select(key, total)
        .join(sums, key)
        .withColumn("difference", F.col(total) - F.col("lines_total"))
        .filter(F.abs("difference") > tolerance)
    )


def orphans(parents: DataFrame, children: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of ``parents`` that no row of ``children`` refers to; ``on`` maps parent to child columns.

    The child keys are made distinct first, so a key that fills a third of the children is one row.
    """
    keys = children.select(*[F.col(child).alias(parent) for parent, child in on.items()]).distinct()
    return parents.join(keys, list(on), "left_anti")


def dates_out_of_order(
    later: DataFrame, earlier: DataFrame, key: str, other_key: str, later_date: str, earlier_date: str
) -> DataFrame:
    """Rows whose date lies before the date of the row they belong to.

    ``earlier`` has one row per key; a hot key on the ``later`` side is split by adaptive skew handling.
    """
    reference = earlier.select(F.col(other_key).alias(key), earlier_date)
    return later.join(reference, key).filter(F.col(later_date) < F.col(earlier_date))

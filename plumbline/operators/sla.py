"""Service levels: attainment, error budgets, burn-down, breach transitions and time to resolve."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.exceptions import at

GOOD, BAD = ("pass", "warn"), ("fail", "error")
TARGETS = {"freshness": ["freshness"], "volume": ["row_count_min", "row_count_anomaly"]}


def target_checks(slas: DataFrame, checks: DataFrame) -> DataFrame:
    """``(sla_id, check_id)``: which checks an SLA counts."""
    direct = slas.filter(F.col("scope") == "check").select("sla_id", F.col("scope_id").alias("check_id"))
    wide = slas.filter(F.col("scope") == "dataset").select("sla_id", F.col("scope_id").alias("dataset_id"), "target_type")
    of = checks.select("check_id", "dataset_id", "check_type")
    counts = F.lit(False)
    for target, kinds in TARGETS.items():
        counts = counts | ((F.col("target_type") == target) & F.col("check_type").isin(*kinds))
    joined = wide.join(of, "dataset_id").filter(counts | ~F.col("target_type").isin(*TARGETS))
    return direct.unionByName(joined.select("sla_id", "check_id"))


def _judge(rows: DataFrame) -> DataFrame:
    """Attainment, budget and breach from ``good``, ``bad`` and ``objective``."""
    total = F.col("good") + F.col("bad")
    attainment = F.when(total > 0, F.col("good") / F.nullif(total, F.lit(0))).otherwise(1.0)
    allowed = F.greatest(F.lit(0.0), 1.0 - F.col("objective"))
    budget = (
        F.when(total == 0, 0.0)
        .when(allowed <= 0, F.when(F.col("bad") > 0, 1.0).otherwise(0.0))
        .otherwise(F.least(F.lit(2.0), F.col("bad") / F.nullif(total, F.lit(0)) / F.nullif(allowed, F.lit(0.0))))
    )
    return (
        rows.withColumn("attainment", F.round(attainment, 6))
        .withColumn("budget_consumed", F.round(budget, 6))
        .withColumn("breached", attainment < F.col("objective"))
    )


def resolve_seconds(exceptions: DataFrame) -> DataFrame:
    """Human-resolved exceptions with their time to resolve; machine-resolved ones have no mark."""
    return exceptions.filter(
        (F.col("status") == "resolved") & F.col("marked_at").isNotNull() & (F.col("marked_at") >= F.col("first_seen_at"))
    ).withColumn("_seconds", F.timestamp_diff("SECOND", F.col("first_seen_at"), F.col("marked_at")))


def evaluate(slas: DataFrame, checks: DataFrame, runs: DataFrame, exceptions: DataFrame, as_of: datetime, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One evaluation per SLA over its rolling window.

    Runs and exceptions shrink to one row per check, with one column per window, before any join, and the
    longest window bounds the scan so that older day partitions are pruned.
    """
    oldest = at(as_of - timedelta(days=max(windows)))
    inside = {n: at(as_of - timedelta(days=n)) for n in windows}
    run_counts = runs.filter(F.col("started_at") >= oldest).groupBy("check_id").agg(
        *[F.count_if((F.col("started_at") >= t) & F.col("status").isin(*GOOD)).alias(f"_good{n}") for n, t in inside.items()],
        *[F.count_if((F.col("started_at") >= t) & F.col("status").isin(*BAD)).alias(f"_bad{n}") for n, t in inside.items()],
    )
    fixes = resolve_seconds(exceptions).filter(F.col("marked_at") >= oldest).groupBy("check_id").agg(
        *[F.sum(F.when(F.col("marked_at") >= t, F.col("_seconds"))).alias(f"_sec{n}") for n, t in inside.items()],
        *[F.count_if(F.col("marked_at") >= t).alias(f"_fix{n}") for n, t in inside.items()],
    )

    def chosen(prefix: str) -> Column:
        pick = None
        for n in windows:
            col = F.col(f"{prefix}{n}")
            pick = F.when(F.col("window_days") == n, col) if pick is None else pick.when(F.col("window_days") == n, col)
        return pick

    per_check = target_checks(slas, checks).join(run_counts, "check_id", "left").join(fixes, "check_id", "left")
    rows = slas.join(per_check, "sla_id", "left").groupBy("sla_id", "scope", "scope_id", "objective", "window_days").agg(
        F.coalesce(F.sum(chosen("_good")), F.lit(0)).alias("good"),
        F.coalesce(F.sum(chosen("_bad")), F.lit(0)).alias("bad"),
        F.sum(chosen("_sec")).alias("_sec"),
        F.sum(chosen("_fix")).alias("_fix"),
    )
    mttr = F.floor(F.col("_sec") / F.nullif(F.col("_fix"), F.lit(0))).cast("bigint")
    return _judge(rows).withColumn("mttr_seconds", mttr).drop("_sec", "_fix")


def burn_down(slas: DataFrame, checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Attainment and budget of each SLA at the end of each day that had runs, over its rolling window.

    Runs become one row per check and day before the join, so a frame never holds more than the days of
    one SLA.
    """
    daily = runs.groupBy("check_id", F.to_date("started_at").alias("day")).agg(
        F.count_if(F.col("status").isin(*GOOD)).alias("_good"), F.count_if(F.col("status").isin(*BAD)).alias("_bad")
    )
    joined = slas.join(target_checks(slas, checks), "sla_id").join(daily, "check_id")
    per_day = joined.groupBy("sla_id", "objective", "window_days", "day").agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"))
    # Both frames share one partitioning and order, hence one sort; each SLA then reads its own.
    frame = {n: Window.partitionBy("sla_id").orderBy(F.unix_date("day")).rangeBetween(-(n - 1), 0) for n in (7, 30)}

    def rolled(column: str) -> Column:
        return F.when(F.col("window_days") == 7, F.sum(column).over(frame[7])).otherwise(F.sum(column).over(frame[30]))

    windowed = per_day.withColumn("good", rolled("_good")).withColumn("bad", rolled("_bad"))
    return _judge(windowed.drop("_good", "_bad"))


def breach_transitions(burn: DataFrame) -> DataFrame:
    """Days on which an SLA became breached."""
    before = F.lag("breached").over(Window.partitionBy("sla_id").orderBy("day"))
    return burn.withColumn("_before", F.coalesce(before, F.lit(False))).filter(F.col("breached") & ~F.col("_before")).drop("_before")


def reliability(evaluations: DataFrame) -> DataFrame:
    """Breached first, then by budget consumed."""
    return evaluations.orderBy(F.desc("breached"), F.desc("budget_consumed"), F.asc("sla_id"))

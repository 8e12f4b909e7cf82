"""Dataset scores, service-level objectives, roll-ups and daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import (
    DEFAULT_SLO_TARGET,
    IMPORTANCE_WEIGHT,
    STATUS_POINTS,
    lookup,
    normalise_importance,
    normalise_status,
    severity_weight,
)
from plumbline.operators.joins import last_per_key, status_as_of_days

# Fixed values of the score: points lost per open exception and the most that can be lost.
PENALTY_PER_OPEN = 2.0
MAX_PENALTY = 30.0
DIMENSIONS = ("domain", "team", "owner", "importance")


def latest_statuses(runs: DataFrame) -> DataFrame:
    """Newest status per check by start time, then id."""
    return last_per_key(runs.select("check_id", "started_at", "run_id", "status"), ["check_id"], ["started_at", "run_id"])


def open_exceptions(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter(F.col("status") == "open").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("open_exceptions"))


def slo_status(score: Column, target: Column, gap: Column, disabled: Column) -> Column:
    return (
        F.when(disabled, "disabled")
        .when(score.isNull() | target.isNull(), "unknown")
        .when(gap >= 0, "met")
        .when(gap >= -2, "at_risk")
        .otherwise("breached")
    )


def dataset_scores(
    datasets: DataFrame, checks: DataFrame, statuses: DataFrame, opened: DataFrame | None = None, also_by: Sequence[str] = ()
) -> DataFrame:
    """Score every dataset from its active checks' statuses and its open exceptions.

    ``datasets`` carries ownership and objectives. ``also_by`` names further keys of ``statuses`` (a day),
    for scoring many days in one job.
    """
    active = checks.filter(F.col("status") == "active").select("check_id", "dataset_id", "severity")
    judged = active.join(statuses.select("check_id", *also_by, F.col("status").alias("_run")), "check_id", "left")
    # Whole units (half weights, tenth points) sum exactly, so a score never depends on the order of rows.
    status, weight = normalise_status(F.col("_run")), (severity_weight(F.col("severity")) * 2).cast("bigint")
    tenths = F.round(lookup(status, STATUS_POINTS, 0.5) * 10).cast("bigint")
    points = judged.groupBy("dataset_id", *also_by).agg(
        F.sum(weight).alias("_weight"),
        F.sum(weight * tenths).alias("_points"),
        F.count(F.lit(1)).alias("active_checks"),
        *[F.count_if(status == s).alias(f"{name}_checks") for s, name in (("pass", "passing"), ("warn", "warning"), ("fail", "failing"), ("error", "error"), ("unknown", "unknown"))],
    )
    out = datasets.join(points, "dataset_id", "left")
    if opened is not None:
        out = out.join(opened, "dataset_id", "left")
    else:
        out = out.withColumn("open_exceptions", F.lit(0))
    counts = ["active_checks", "passing_checks", "warning_checks", "failing_checks", "error_checks", "unknown_checks", "open_exceptions"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    base = F.round(F.col("_points") * 1000 / F.nullif(F.col("_weight"), F.lit(0))) / 100
    penalty = F.least(F.lit(MAX_PENALTY), F.col("open_exceptions") * PENALTY_PER_OPEN)
    out = out.withColumn("base_score", base).withColumn(
        "exception_penalty", F.when(F.col("base_score").isNull(), 0.0).otherwise(penalty)
    )
    importance = normalise_importance(F.col("importance"))
    out = out.withColumn("importance", importance).withColumn("importance_weight", lookup(F.col("importance"), IMPORTANCE_WEIGHT))
    # greatest and least skip NULLs, so an unscored dataset has to be kept out of them.
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base_score") - F.col("exception_penalty"))), 2)
    out = out.withColumn("score", F.when(F.col("base_score").isNotNull(), clamped))
    enabled = F.coalesce(F.col("slo_enabled"), F.lit(True))
    explicit = F.round("slo_target_score", 2)
    out = out.withColumn("slo_target", F.when(enabled, F.coalesce(explicit, lookup(F.col("importance"), DEFAULT_SLO_TARGET))))
    out = out.withColumn("score_gap", F.when(enabled, F.round(F.col("score") - F.col("slo_target"), 2)))
    out = out.withColumn("slo_status", slo_status(F.col("score"), F.col("slo_target"), F.col("score_gap"), ~enabled))
    facts = ["table_name", "domain", "team", "owner", "importance", "importance_weight"]
    return out.select(
        "dataset_id", *also_by, *[F.coalesce(c, F.lit("")).alias(c) if c in ("domain", "team", "owner") else F.col(c) for c in facts],
        "base_score", "exception_penalty", "score", "slo_target", "slo_status", "score_gap", *counts,
    )


def rollups(scores: DataFrame, also_by: Sequence[str] = ()) -> DataFrame:
    """Importance-weighted roll-ups over all datasets, each dimension and each dataset, in one aggregation."""
    keyed = scores.withColumn("dataset", F.col("dataset_id").cast("string"))
    dims = [*DIMENSIONS, "dataset"]
    sets = [list(also_by), *[[*also_by, d] for d in dims]]
    w, target = F.col("importance_weight").cast("bigint"), F.col("slo_target").isNotNull() & (F.col("slo_status") != "disabled")
    scored = F.col("score").isNotNull()

    def weighted(value: str, where: Column) -> Column:
        # Hundredths and whole weights sum exactly.
        hundredths = F.round(F.col(value) * 100).cast("bigint")
        return F.round(F.sum(F.when(where, hundredths * w)) / F.nullif(F.sum(F.when(where, w)), F.lit(0))) / 100

    counts = ["active_checks", "passing_checks", "warning_checks", "failing_checks", "error_checks", "unknown_checks", "open_exceptions"]
    grouped = keyed.groupingSets(sets, *also_by, *dims).agg(
        F.grouping_id().alias("_g"),
        weighted("score", scored).alias("score"),
        weighted("slo_target", target).alias("slo_target"),
        F.count(F.lit(1)).alias("total_datasets"),
        F.count_if(scored).alias("scored_datasets"),
        F.count_if(target).alias("_targets"),
        F.bool_and(F.col("slo_status") == "disabled").alias("_disabled"),
        *[F.sum(c).alias(c) for c in counts],
        *[F.count_if(F.col("slo_status") == s).alias(f"slo_{s}") for s in ("met", "at_risk", "breached", "unknown", "disabled")],
    )
    # The grouping id has one bit per column, the last column lowest; the grouped dimension's bit is off.
    every = (1 << len(dims)) - 1
    bits = {d: every & ~(1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    grain, key = F.when(F.col("_g") == every, "global"), F.when(F.col("_g") == every, "")
    for d, bit in bits.items():
        grain, key = grain.when(F.col("_g") == bit, d), key.when(F.col("_g") == bit, F.col(d))
    out = grouped.withColumn("grain", grain).withColumn("key", key).withColumn("score_gap", F.round(F.col("score") - F.col("slo_target"), 2))
    disabled = (F.col("_targets") == 0) & F.col("_disabled")
    out = out.withColumn("slo_status", slo_status(F.col("score"), F.col("slo_target"), F.col("score_gap"), disabled))
    label = F.when(F.col("grain") == "global", "All datasets").when(F.col("key") == "", "Unassigned").otherwise(F.col("key"))
    return out.select(
        *also_by, "grain", "key", label.alias("label"), "score", "slo_target", "slo_status",
        F.when(F.col("slo_status").isin("disabled", "unknown"), F.lit(None)).otherwise(F.col("score_gap")).alias("score_gap"),
        "total_datasets", "scored_datasets", *counts, "slo_met", "slo_at_risk", "slo_breached", "slo_unknown", "slo_disabled",
    )


def attention_order() -> list[Column]:
    """Unscored last, worst score first, most open exceptions first, then by name."""
    return [F.asc_nulls_last("score"), F.desc("open_exceptions"), F.asc(F.lower("table_name")), F.asc("dataset_id")]


def worst_rollups(rolled: DataFrame, k: int = 5) -> DataFrame:
    order = [F.when(F.col("slo_status") == "breached", 0).otherwise(1), F.asc("score"), F.asc(F.lower("label")), F.asc("grain")]
    return rolled.filter(F.col("grain").isin("domain", "team") & F.col("score").isNotNull()).orderBy(*order).limit(k)


def page(scores: DataFrame, domain: str | None = None, team: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    out = scores
    for name, value in (("domain", domain), ("team", team)):
        if value is not None:
            out = out.filter(F.lower(F.trim(name)) == value.strip().lower())
    return out.orderBy(*attention_order()).offset(offset).limit(limit)


def backfill(datasets: DataFrame, checks: DataFrame, runs: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Scores of every dataset at the end of each day that had runs, in one job.

    A check without a run yet counts as unknown: it gets one opening row on the first day, and that row
    stretches to its first run like any other status.
    """
    active = checks.filter(F.col("status") == "active").select("check_id")
    known = runs.select("check_id", "started_at", "run_id", "status").join(active, "check_id", "left_semi")
    opening = active.select("check_id", first_day.cast("timestamp_ntz").alias("started_at"), F.lit(-1).cast("bigint").alias("run_id"), F.lit("unknown").alias("status"))
    stretched = status_as_of_days(known.unionByName(opening), ["check_id"], last_day)
    run_days = runs.select(F.to_date("started_at").alias("day")).distinct().filter(F.col("day").between(first_day, last_day))
    statuses = stretched.join(run_days, "day", "left_semi")
    return dataset_scores(datasets, checks, statuses, None, ["day"]).filter(F.col("day").isNotNull())


def history(snapshots: DataFrame, grain: str, since: Column) -> DataFrame:
    return snapshots.filter((F.col("grain") == grain) & (F.col("day") >= since)).orderBy("day", "key")

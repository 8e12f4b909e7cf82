"""Checks against a table's own run history: adaptive freshness and row-count anomalies.

Both judge *every* run at once against the runs before it, so a backfill of years is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered
from plumbline.operators.ordered import lookback


def _median(values: Column) -> Column:
    """Median of an array; Spark has no framed median."""
    ordered = F.array_sort(values)
    size = F.size(values)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return (low + high) / 2.0


def volume_sigma(
    runs: DataFrame,
    key: str,
    order: Sequence[str],
    count: str,
    chunk: Column,
    lookback_runs: int = 14,
    min_history: int = 5,
    sigma: float = 3.0,
) -> DataFrame:
    """z-score of each run's row count against the mean and population deviation of the runs before it."""
    value = F.col(count).cast("double")
    runs, chunk = ordered.spread(runs, [key], order, chunk)
    seen = lookback(
        runs,
        [key],
        order,
        lookback_runs,
        {
            "history_n": lambda w: F.count(count).over(w),
            "_mean": lambda w: F.avg(value).over(w),
            "_sd": lambda w: F.stddev_pop(value).over(w),
        },
        chunk,
    )
    ready = F.col("history_n") >= min_history
    spread = F.greatest(F.col("_sd"), F.lit(1.0), F.col("_mean") * 0.005)
    z = F.when(ready, (value - F.col("_mean")) / spread)
    return (
        seen.withColumn("mean", F.when(ready, F.col("_mean")))
        .withColumn("std", F.when(ready, spread))
        .withColumn("z", z)
        .withColumn("violation_count", F.when(F.abs(z) > sigma, 1).otherwise(0).cast("bigint"))
        .drop("_mean", "_sd", ordered.PART)
    )


def volume_adaptive(
    runs: DataFrame,
    key: str,
    order: Sequence[str],
    count: str,
    chunk: Column,
    lookback_runs: int = 14,
    min_history: int = 5,
    multiplier: float = 3.5,
) -> DataFrame:
    """Median and MAD bounds from the runs before each run."""
    value = F.col(count).cast("double")
    runs, chunk = ordered.spread(runs, [key], order, chunk)
    # At most `lookback_runs` numbers per row are gathered, never a whole history.
    seen = lookback(runs, [key], order, lookback_runs, {"_past": lambda w: F.collect_list(value).over(w)}, chunk)
    ready = F.size("_past") >= min_history
    centred = seen.withColumn("history_n", F.size("_past")).withColumn("_center", _median(F.col("_past")))
    mad = _median(F.transform("_past", lambda v: F.abs(v - F.col("_center"))))
    spread = F.greatest(mad * 1.4826, F.lit(1.0), F.abs("_center") * 0.005)
    bounds = centred.withColumn("_spread", spread)
    lower = F.greatest(F.lit(0.0), F.col("_center") - multiplier * F.col("_spread"))
    upper = F.col("_center") + multiplier * F.col("_spread")
    return (
        bounds.withColumn("baseline_center", F.when(ready, F.col("_center")))
        .withColumn("lower_bound", F.when(ready, lower))
        .withColumn("upper_bound", F.when(ready, upper))
        .withColumn("score", F.when(ready, (value - F.col("_center")) / F.col("_spread")))
        .withColumn("violation_count", F.when(ready & ((value < lower) | (value > upper)), 1).otherwise(0).cast("bigint"))
        .drop("_past", "_center", "_spread", ordered.PART)
    )


def adaptive_max_age(
    history: DataFrame,
    key: str,
    order: Sequence[str],
    latest: str,
    default_hours: float,
    lookback_runs: int = 14,
    min_history: int = 3,
    multiplier: float = 2.0,
    grace_hours: float = 0.0,
) -> DataFrame:
    """Per key, the allowed age learned from the gaps between the newest values of recent runs.

    The last ``lookback_runs`` runs count even where they lack the metric. The ranking keeps N rows per
    key on the map side (group limit), so a key with most of the history costs no more than another.
    """
    backwards = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    recent = history.withColumn("_age", F.row_number().over(backwards)).filter(F.col("_age") <= lookback_runs)
    stamped = recent.filter(F.col(latest).isNotNull())
    gaps = stamped.withColumn("_older", F.lag(latest).over(Window.partitionBy(key).orderBy(F.desc("_age"))))
    hours = F.timestamp_diff("SECOND", F.col("_older"), F.col(latest)) / 3600.0
    # Bounded by lookback_runs values per key.
    learned = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("history_n"),
        F.collect_list(F.when(F.col(latest) > F.col("_older"), hours)).alias("_gaps"),
    )
    enough = (F.col("history_n") >= min_history) & (F.size("_gaps") >= max(1, min_history - 1))
    limit = F.greatest(F.lit(0.0), _median(F.col("_gaps")) * multiplier + grace_hours)
    return learned.select(
        key,
        "history_n",
        F.size("_gaps").alias("intervals_n"),
        F.when(enough, limit).otherwise(F.lit(float(default_hours))).alias("max_age_hours"),
        F.when(enough, F.lit("history")).otherwise(F.lit("default")).alias("threshold_source"),
    )

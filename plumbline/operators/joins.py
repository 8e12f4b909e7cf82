"""Join shapes that stay balanced when few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join on a key with very few values (a severity, a status).

    ``many`` is spread over ``salts`` sub-keys by a hash of ``spread_by``; ``few`` is repeated once per
    sub-key. No side has to fit in memory and no key ends in one task.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key as an aggregate, which combines on the map side; no sort, no self join."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_last")).select(*keys, "_last.*")


def reconcile_specs(desired: DataFrame, managed: DataFrame, keys: Sequence[str], body: Sequence[str]) -> DataFrame:
    """Plan to bring managed specs in line with desired ones: create, update, enable, disable or keep.

    Of several managed specs with one key the lowest id stays and the rest are disabled.
    """
    kept = managed.groupBy(*keys).agg(F.min("spec_id").alias("spec_id"))
    current = managed.join(kept.withColumnRenamed("spec_id", "_kept"), list(keys))
    doubles = current.filter((F.col("spec_id") != F.col("_kept")) & (F.col("status") != "disabled")).select(
        *keys, "spec_id", F.lit("disable_duplicate").alias("action")
    )
    first = current.filter(F.col("spec_id") == F.col("_kept")).select(
        *keys, "spec_id", "status", F.struct(*[F.col(c) for c in body]).alias("_old")
    )
    wanted = desired.select(*keys, F.struct(*[F.col(c) for c in body]).alias("_new"))
    both = wanted.join(first, list(keys), "full_outer")
    action = (
        F.when(F.col("spec_id").isNull(), "create")
        .when(F.col("_new").isNull(), F.when(F.col("status") != "disabled", "disable").otherwise("keep"))
        .when((F.col("status") == "disabled") | ~F.col("_new").eqNullSafe(F.col("_old")), "update")
        .otherwise("keep")
    )
    return both.select(*keys, "spec_id", action.alias("action")).unionByName(doubles)


def status_as_of_days(runs: DataFrame, keys: Sequence[str], last_day: Column) -> DataFrame:
    """Status of each key at the end of every calendar day from its first run to ``last_day``.

    Runs shrink to one row per key and day first; each of those then stretches to the day before the next
    one. No day grid is crossed with the keys and no range join runs.
    """
    daily = runs.groupBy(*keys, F.to_date("started_at").alias("_from")).agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("status"), F.max("run_id").alias("run_id")
    )
    upto = F.coalesce(F.date_sub(F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from")), 1), last_day)
    return (
        daily.withColumn("_upto", upto)
        .filter(F.col("_from") <= F.col("_upto"))
        .select(*keys, F.explode(F.sequence("_from", "_upto")).alias("day"), "status", "run_id")
    )


#: Rows of which one task keeps the distinct ones.
DISTINCT_ROWS = 500_000


def distinct_rows(df: DataFrame, rows: int) -> DataFrame:
    """Distinct rows of a table of about ``rows`` rows, dealt out to as many tasks as it needs: a task's memory stays the same."""
    return df.repartition(max(1, -(-rows // DISTINCT_ROWS)), *df.columns).distinct()

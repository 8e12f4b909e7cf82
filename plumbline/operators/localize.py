"""Where and since when do violations happen: attribution and localisation over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import as_text, group_key, restore_long_values


def attribution_factors(df: DataFrame, failing: Column, columns: Sequence[str], pii: Iterable[str] = (), k: int = 8) -> DataFrame:
    """Column values that separate failing rows from healthy ones, best first.

    Every row counts, and both sides come out of one pass: cells are counted by (column, value) with the
    failing and healthy tallies side by side, combined on the map side. Masked columns never leave the scan.
    Without healthy rows nothing can be told apart: no factors then, and :func:`attribution_gap` says why.
    """
    hidden = {p.lower() for p in pii}
    fields = [f for f in df.schema.fields if f.name in set(columns) and f.name.lower() not in hidden]
    bad = F.coalesce(failing, F.lit(False))
    texts = df.select(bad.alias("_bad"), *[group_key(as_text(f)).alias(f.name) for f in fields])
    cells = texts.unpivot(["_bad"], [f.name for f in fields], "column_name", "value")
    counts = cells.groupBy("column_name", "value").agg(
        F.count_if("_bad").alias("fail_count"), F.count_if(~F.col("_bad")).alias("healthy_count")
    )
    totals = texts.agg(F.count_if("_bad").alias("b"), F.count_if(~F.col("_bad")).alias("g"))
    n_bad, n_good = totals.select("b").scalar(), totals.select("g").scalar()
    fail = F.col("fail_count") / F.nullif(n_bad, F.lit(0))
    healthy = F.coalesce(F.col("healthy_count") / F.nullif(n_good, F.lit(0)), F.lit(0.0))
    scored = counts.filter((F.col("fail_count") > 0) & (n_good > 0)).select(
        "column_name",
        "value",
        "fail_count",
        "healthy_count",
        F.round(fail * 100, 2).alias("fail_pct"),
        F.round(healthy * 100, 2).alias("healthy_pct"),
        F.round(fail / (healthy + F.lit(1e-9)), 2).alias("lift"),
        F.round(fail * 0.6 + F.greatest(fail - healthy, F.lit(0.0)) * 0.4, 6).alias("score"),
    )
    order = [F.desc("score"), F.desc("fail_pct"), F.asc("column_name"), F.asc("value")]
    return restore_long_values(df.select(*[F.col(f"`{f.name}`") for f in fields]), scored.orderBy(*order).limit(k)).orderBy(*order)


def attribution_gap(df: DataFrame, failing: Column) -> DataFrame:
    """One row: failing and healthy rows, and why attribution is not computable (null where it is)."""
    bad = F.coalesce(failing, F.lit(False))
    seen = df.agg(F.count_if(bad).alias("failing_rows"), F.count_if(~bad).alias("healthy_rows"))
    why = F.when(F.col("failing_rows") == 0, "no failing rows").when(F.col("healthy_rows") == 0, "no healthy rows")
    return seen.withColumn("reason", why)


def best_segment(facts: DataFrame, distinct: DataFrame, exclude: str | None = None) -> str | None:
    """The string column with the fewest values, between 2 and 20; reads one row of the profile."""
    usable = facts.join(distinct, "column_name").filter((F.col("kind") == "string") & F.col("distinct_count").between(2, 20))
    if exclude:
        usable = usable.filter(F.col("column_name") != exclude)
    first = usable.orderBy("distinct_count", "ordinal").select("column_name").head(1)
    return first[0]["column_name"] if first else None


def by_segment(df: DataFrame, where: Column, segment: str, k: int = 25) -> DataFrame:
    return df.filter(where).groupBy(segment).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(segment)).limit(k)


def by_day(df: DataFrame, where: Column, stamp: str, k: int = 30) -> DataFrame:
    return df.filter(where).groupBy(F.to_date(stamp).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(k)


def latest_per_day(df: DataFrame, stamp: str, k: int = 30) -> DataFrame:
    counted = df.groupBy(F.to_date(stamp).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("latest"))
    return counted.orderBy(F.desc("day")).limit(k)


def extremes(df: DataFrame, column: str, tie_break: Sequence[str], k: int = 25) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).orderBy(F.desc(column), *[F.asc(c) for c in tie_break]).limit(k)


def distinct_values(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("value")).limit(k)


def bucket_chart(df: DataFrame, column: str, width: float, k: int = 80) -> DataFrame:
    """Equal-width buckets ``round(x / w) * w``."""
    bucket = F.round(F.col(column) / width) * width
    return df.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").limit(k)

"""Profile a table: one wide pass for column facts, one value-frequency table for everything about distinctness.

The frequency table (values counted on the map side) feeds distinct counts, top values and samples; exact quantiles
come from band counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import FORMAT_PATTERNS
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.schemachecks import column_kind

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
LONG_TEXT = 64


def group_key(value: Column) -> Column:
    """A text to group by: itself, or the digest of all of it where it is long.

    Long documents then cross the network as 71 bytes. A digest is longer than LONG_TEXT, so it cannot
    equal a short value.
    """
    return F.when(F.octet_length(value) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)


def as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if column_kind(field.dataType) == "other":
        return F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    return c.cast("string")


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column: counts, bounds, moments, lengths, format ratios. One scan, one small exchange."""
    fields = df.schema.fields
    rows = F.count(F.lit(1)).alias("_rows")
    aggs: list[Column] = [rows]
    for i, f in enumerate(fields):
        c, kind = F.col(f"`{f.name}`"), column_kind(f.dataType)
        aggs.append(F.count(c).alias(f"_n{i}"))
        if kind in ("numeric", "temporal", "string", "boolean"):
            aggs += [F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}")]
        if kind == "numeric":
            x = c.cast("double")
            x = F.when(~F.isnan(x), x)
            aggs += [F.avg(x).alias(f"_avg{i}"), F.stddev_samp(x).alias(f"_sd{i}")]
        if kind == "string":
            length = F.char_length(c)
            aggs += [F.min(length).alias(f"_minl{i}"), F.avg(length).alias(f"_avgl{i}"), F.max(length).alias(f"_maxl{i}")]
            aggs += [F.avg(F.regexp_like(c, F.lit(p)).cast("int")).alias(f"_{name}{i}") for name, p in FORMAT_PATTERNS.items()]
            parsed = F.try_to_timestamp(c).cast("timestamp_ntz")
            aggs += [F.avg(F.when(c.isNotNull(), parsed.isNotNull().cast("int"))).alias(f"_dates{i}"), F.max(parsed).alias(f"_maxts{i}")]
    wide = df.agg(*aggs)
    have = set(wide.columns)

    def pick(name: str, i: int, cast: str) -> Column:
        return (F.col(f"{name}{i}") if f"{name}{i}" in have else F.lit(None)).cast(cast)

    lines = []
    for i, f in enumerate(fields):
        kind = column_kind(f.dataType)
        stamp = pick("_max", i, "timestamp_ntz") if kind == "temporal" else F.when(
            (pick("_date_like", i, "double") >= 0.95) & (pick("_dates", i, "double") >= 0.95), pick("_maxts", i, "timestamp_ntz")
        ) if kind == "string" else F.lit(None).cast("timestamp_ntz")
        lines.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(kind).alias("kind"),
                F.col("_rows").alias("row_count"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("null_count"),
                F.round((F.col("_rows") - F.col(f"_n{i}")) / F.nullif(F.col("_rows"), F.lit(0)), 6).alias("null_pct"),
                pick("_min", i, "string").alias("min_value"),
                pick("_max", i, "string").alias("max_value"),
                (pick("_min", i, "double") if kind == "numeric" else F.lit(None).cast("double")).alias("min_number"),
                (pick("_max", i, "double") if kind == "numeric" else F.lit(None).cast("double")).alias("max_number"),
                pick("_avg", i, "double").alias("mean"),
                (F.when(F.col(f"_n{i}") > 1, pick("_sd", i, "double")).otherwise(0.0) if kind == "numeric" else F.lit(None).cast("double")).alias("stddev"),
                pick("_minl", i, "int").alias("min_len"),
                F.round(pick("_avgl", i, "double"), 2).alias("avg_len"),
                pick("_maxl", i, "int").alias("max_len"),
                *[F.round(pick(f"_{name}", i, "double"), 4).alias(name) for name in FORMAT_PATTERNS],
                stamp.alias("max_ts"),
            )
        )
    return wide.select(F.inline(F.array(*lines)))


def frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` of all non-null values; long texts appear as their digest."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    texts = df.select(*[group_key(as_text(f)).alias(f.name) for f in fields])
    cells = texts.unpivot([], [F.col(f"`{f.name}`") for f in fields], "column_name", "value")
    return cells.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def approximate_distinct(df: DataFrame) -> DataFrame:
    """Sketch-based distinct counts of all columns in one pass, for tables too wide to count exactly."""
    wide = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in df.columns])
    return wide.unpivot([], list(df.columns), "column_name", "distinct_count")


def distinct_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def top_values(freq: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column, ties by value (by digest for long texts).

    The rank filter keeps ``k`` rows per column on the map side before the ranking shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value")))
    return freq.withColumn("rank", rank).filter(F.col("rank") <= k)


def restore_long_values(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """Put the whole text back where :func:`frequencies` used a digest, for rows of :func:`top_values`."""
    strings = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return ranked
    picked = ranked.filter(F.col("value").startswith("sha256:")).select("column_name", "value")
    cells = df.select(*[F.when(F.octet_length(F.col(f"`{f.name}`")) > LONG_TEXT, F.col(f"`{f.name}`")).alias(f.name) for f in strings])
    cells = cells.unpivot([], [F.col(f"`{f.name}`") for f in strings], "column_name", "_text").filter(F.col("_text").isNotNull())
    # `picked` holds k rows per column, so it is broadcast; one text per picked digest is kept.
    whole = (
        cells.withColumn("value", group_key(F.col("_text")))
        .join(F.broadcast(picked), ["column_name", "value"])
        .groupBy("column_name", "value")
        .agg(F.max("_text").alias("_whole"))
    )
    out = ranked.join(whole, ["column_name", "value"], "left")
    return out.withColumn("value", F.coalesce("_whole", "value")).drop("_whole")


def sample_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` smallest values of each column: a sample that does not change between runs."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return freq.withColumn("rank", rank).filter(F.col("rank") <= k)


def numeric_quantiles(df: DataFrame, probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles of the numeric columns."""
    return exact_quantiles(df, [f.name for f in df.schema.fields if column_kind(f.dataType) == "numeric"], probabilities)


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES) -> DataFrame:
    """Sketch-based quantiles of all columns in one pass."""
    wide = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probabilities), 10000).alias(c) for c in columns])
    lines = [
        F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("p"), F.get(F.col(c), F.lit(i)).alias("q"))
        for c in columns
        for i, p in enumerate(probabilities)
    ]
    return wide.select(F.inline(F.array(*lines)))


def profile(df: DataFrame) -> DataFrame:
    """The whole profile, one row per column, with quantiles as a map and top values as an array."""
    facts, freq = column_facts(df), frequencies(df)
    ranked = restore_long_values(df, top_values(freq))
    tops = ranked.groupBy("column_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))
        ).alias("top_values")
    )
    samples = sample_values(freq).groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    quant = (
        numeric_quantiles(df)
        .groupBy("column_name")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("p").cast("string"), "q")))).alias("quantiles"))
    )
    joined = facts.join(distinct_counts(freq), "column_name", "left")
    for part in (tops, samples, quant):
        joined = joined.join(part, "column_name", "left")
    return joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))).withColumn(
        "distinct_pct", F.round(F.col("distinct_count") / F.nullif(F.col("row_count"), F.lit(0)), 6)
    )


def key_candidates(facts: DataFrame, distinct: DataFrame, min_rows: int = 100) -> DataFrame:
    """Columns without NULLs whose values are all distinct, in tables of at least ``min_rows`` rows."""
    joined = facts.join(distinct, "column_name")
    full = (F.col("row_count") >= min_rows) & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
    return joined.filter(full)


def temporal_candidates(facts: DataFrame) -> DataFrame:
    """Temporal columns and text columns that hold dates, with their newest value."""
    return facts.filter(F.col("max_ts").isNotNull()).select("column_name", "kind", "max_ts")

"""Ordered computations that survive a hot key.

A plain window over ``partitionBy(key)`` puts every row of a key into one task. The functions here split
each key's order into *chunks* (a day, an hour, a value band), work inside ``(key, chunk)``, and carry
one summary row per chunk across, so the only window over the bare key runs on chunk summaries. All
results are exact: they equal the plain window.

``chunk`` must be a deterministic expression that never decreases along the order. A day is no bound: a key can have all
its rows in one. :func:`spread` finds keys with crowded chunks and gives them chunks that are ranges of the order itself.

Each local window is preceded by an explicit ``repartition`` on all of its keys. It takes the place of the
exchange the window needs anyway; without it, rows that already sit together by key alone (after a join on
the key, say) would count as clustered and a hot key would stay in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored

#: More rows than this of one key in one chunk are crowded.
CROWD = 200_000
#: The column that :func:`spread` adds.
PART = "_part"


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> tuple[DataFrame, Column]:
    """``df`` and a chunk of it in which no key has far more than ``CROWD`` rows, ties in all of ``order`` apart.

    Where a key is crowded in a chunk, the rows are dealt out by ranges of (keys, order), whose borders Spark takes from a
    sample, and a row's range becomes its chunk: borders fall inside heavy keys as often as they have rows, on any of the
    order's columns. The ranges are written once, so that all later steps see the same. Else ``df`` stays as it is; the
    question costs one aggregation that combines before its shuffle.
    """
    crowds = df.groupBy(*keys, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    seen = crowds.agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    if (seen["most"] or 0) <= CROWD:
        return df, chunk
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * seen["rows"] // CROWD + 1)
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id())
    return stored(dealt, "ordered-ranges"), F.col(PART)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], chunk: Column) -> DataFrame:
    """For each row and name, the last non-null value among the rows before it along ``order``."""
    names = list(values)
    base = df.withColumn("_chunk", chunk).withColumns({f"_value_{n}": values[n] for n in names})
    at = F.struct(*[F.col(c) for c in order])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        base.groupBy(*keys, "_chunk")
        .agg(*[F.max_by(f"_value_{n}", F.when(F.col(f"_value_{n}").isNotNull(), at)).alias(f"_tail_{n}") for n in names])
        .select(*keys, "_chunk", *[F.last(f"_tail_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in names])
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.repartition(*keys, "_chunk").withColumns({f"_near_{n}": F.last(f"_value_{n}", ignorenulls=True).over(inside) for n in names})
    joined = local.join(carried, [*keys, "_chunk"])
    return joined.select(*[F.col(c) for c in df.columns], *[F.coalesce(f"_near_{n}", f"_carry_{n}").alias(n) for n in names])


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], chunk: Column, prefix: str = "prev_"
) -> DataFrame:
    """``lag`` of ``cols`` along ``order`` within ``keys``; a struct keeps null cells apart from no row."""
    seen = carry_forward(df, keys, order, {"_seen": F.struct(*[F.col(c) for c in cols])}, chunk)
    return seen.select(*[F.col(c) for c in df.columns], *[F.col("_seen")[c].alias(prefix + c) for c in cols])


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], chunk: Column
) -> DataFrame:
    """Inclusive running sums of ``totals`` along ``order`` within ``keys``."""
    base = df.withColumn("_chunk", chunk)
    names = list(totals)
    base = base.withColumns({f"_part_{n}": totals[n] for n in names})
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        base.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_part_{n}").alias(f"_sum_{n}") for n in names])
        .select(
            *keys,
            "_chunk",
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in names],
        )
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.repartition(*keys, "_chunk").withColumns({f"_run_{n}": F.sum(f"_part_{n}").over(inside) for n in names})
    joined = local.join(carried, [*keys, "_chunk"])
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_run_{n}") + F.col(f"_carry_{n}")).alias(n) for n in names]
    )


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    measures: Mapping[str, Callable[[object], Column]],
    chunk: Column,
    block: int = 4096,
) -> DataFrame:
    """Evaluate ``measures`` over the ``rows`` rows before each row, without the row itself.

    Rows are numbered with :func:`running_totals`, cut into blocks, and the last ``rows`` rows of a block
    are also sent to the next one, so each frame is whole inside its block however long the key's history.
    """
    block = max(block, rows)
    numbered = running_totals(df, keys, order, {"_pos": F.lit(1)}, chunk)
    home = F.floor((F.col("_pos") - 1) / block)
    in_tail = (F.col("_pos") - 1) % block >= block - rows
    spread = numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-rows, -1)
    measured = spread.repartition(*keys, "_block").withColumns({name: make(frame) for name, make in measures.items()})
    return measured.filter(F.col("_block") == F.col("_home")).drop("_pos", "_home", "_block")

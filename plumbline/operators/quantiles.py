"""Exact order statistics over whole columns by narrowing counts, without a sort and without a task that holds a column.

The values between two known bounds are counted in ``BINS`` bins of equal width, with the least and greatest value of
each bin. A wanted rank lies in one bin; its values are counted in narrower bins in the next round, until that bin has
one value. Bins are arithmetic on the value, inside generated code, and combine before the shuffle. A round divides the
range by ``BINS``, so even the widest range of doubles takes a few rounds, and values are written once they are few.
Largest gaps between two distributions are found in the same way (``largest_gap``): the counts at a bin's ends bound the
gap inside it, and only bins whose bound beats the best gap so far are looked at again.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored

BINS = 1024


def finite(x: Column) -> Column:
    """The value as it is, null where it is no finite number; negative zero becomes zero."""
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x + F.lit(0.0))


def _scale(low: float, high: float) -> tuple[float, float]:
    """A factor and the width of a range times that factor, such that the width is finite."""
    width = high - low
    return (0.5, high * 0.5 - low * 0.5) if math.isinf(width) else (1.0, width)


def _bin(value: Column, low: Column, factor: Column, width: Column) -> Column:
    """The bin of a value in a range; monotone in the value, with the bounds in different bins unless they are equal."""
    share = (value * factor - low * factor) / width
    return F.when(width > 0, F.least(F.lit(BINS - 1), F.floor(share * BINS))).otherwise(0).cast("int")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``(column_name, p, q)`` with linear interpolation between the two nearest ranks, of the finite values of ``columns``.

    A column without values has no rows. The driver sees at most ``BINS`` counts for each column and, from the second
    round on, for each bin that holds a wanted rank: a number that columns and probabilities bound.
    """
    spark = df.sparkSession
    numbers = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    facts = [f(f"x{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    seen = numbers.agg(*facts).first()
    used = [i for i in range(len(columns)) if seen[f"n{i}"]]
    places = [(i, p, p * (seen[f"n{i}"] - 1)) for i in used for p in map(float, probabilities)]
    # Open bins by number, each with its bounds and its wanted ranks: (rank within the bin, column, rank within the column).
    wanted: dict[int, list[tuple[int, int, int]]] = {i: [(r, i, r) for r in sorted({f(at) for c, _, at in places if c == i for f in (math.floor, math.ceil)})] for i in used}
    bounds = {i: (seen[f"lo{i}"], seen[f"hi{i}"]) for i in used}
    value_at: dict[tuple[int, int], float] = {}

    def settle() -> None:
        for k in [k for k in wanted if bounds[k][0] == bounds[k][1]]:
            value_at.update({(column, rank): bounds[k][0] for _, column, rank in wanted.pop(k)})

    settle()
    # The first round takes its bounds as constants, so it needs no join.
    one = lambda i: F.struct(F.lit(i).alias("part"), F.col(f"x{i}").alias("value"), _bin(F.col(f"x{i}"), F.lit(bounds[i][0]), *map(F.lit, _scale(*bounds[i]))).alias("bin"))
    cells = numbers.select(F.inline(F.array(*map(one, wanted)))).filter(F.col("value").isNotNull()) if wanted else None
    while wanted:
        counts: dict[int, list[tuple[int, int, float, float]]] = {}
        for r in cells.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
            counts.setdefault(r["part"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        before, hits = dict(wanted), []
        wanted.clear()
        for part, ranks in before.items():
            bins = sorted(counts[part])
            upto = list(accumulate((n for _, n, _, _ in bins), initial=0))
            for rank, column, whole in ranks:
                at = bisect_right(upto, rank) - 1
                if not hits or hits[-1][:2] != (part, bins[at][0]):
                    hits.append((part, bins[at][0], len(hits)))
                    bounds[len(hits) - 1] = bins[at][2:]
                wanted.setdefault(len(hits) - 1, []).append((rank - upto[at], column, whole))
        settle()
        if wanted:
            open_bins = [(part, nth, k, bounds[k][0], *_scale(*bounds[k])) for part, nth, k in hits if k in wanted]
            known = spark.createDataFrame(open_bins, "part int, bin int, next int, low double, factor double, width double")
            # At most two bins for each column and probability.
            inner = stored(cells.join(F.broadcast(known), ["part", "bin"]).select("next", "low", "factor", "width", "value"), "quantile-cells")
            cells = inner.select(F.col("next").alias("part"), "value", _bin(F.col("value"), F.col("low"), F.col("factor"), F.col("width")).alias("bin"))
    rows = []
    for i, p, at in places:
        low, high = value_at[i, math.floor(at)], value_at[i, math.ceil(at)]
        rows.append((columns[i], p, low + (high - low) * (at - math.floor(at))))
    return spark.createDataFrame(rows, "column_name string, p double, q double")


def largest_gap(current: DataFrame, prior: DataFrame, column: str) -> tuple[float | None, int, int]:
    """The largest gap between the empirical distributions of two samples, and the samples' sizes.

    NULL and NaN are left out, infinite values count. The gap is None where a sample is empty. A round counts the values
    of open bins in ``BINS`` bins each and takes the gap at each bin's end, which is exact. What the gap can be inside a
    bin is bounded by its two ends, and only bins whose bound beats the best gap stay open. Running counts go through a
    window over the bins of one range, never over values.
    """

    def side(df: DataFrame, n_current: int) -> DataFrame:
        x = F.col(f"`{column}`").cast("double") + F.lit(0.0)
        return df.select(x.alias("value"), F.lit(n_current).alias("a")).filter(F.col("value").isNotNull() & ~F.isnan("value"))

    both = side(current, 1).unionByName(side(prior, 0))
    # Infinite values are the outermost ones: below, they take part in the counts, not in the arithmetic of bins.
    inner = ~F.col("value").isin(float("inf"), float("-inf"))
    below = F.col("value") == float("-inf")
    seen = both.agg(
        F.count_if(F.col("a") == 1).alias("n_a"), F.count_if(F.col("a") == 0).alias("n_b"), F.count_if(below & (F.col("a") == 1)).alias("low_a"), F.count_if(below & (F.col("a") == 0)).alias("low_b"),
        F.min(F.when(inner, F.col("value"))).alias("lo"), F.max(F.when(inner, F.col("value"))).alias("hi"),
    ).first()
    n_a, n_b = seen["n_a"], seen["n_b"]
    if not n_a or not n_b:
        return None, n_a, n_b
    best = abs(seen["low_a"] / n_a - seen["low_b"] / n_b)
    if seen["lo"] is None:
        return best, n_a, n_b
    spark = current.sparkSession
    start = [(0, seen["lo"], *_scale(seen["lo"], seen["hi"]), seen["low_a"], seen["low_b"])]
    ranges = spark.createDataFrame(start, "part bigint, low double, factor double, width double, from_a bigint, from_b bigint")
    cells = both.filter(inner).select(F.lit(0).cast("bigint").alias("part"), "value", "a")
    gap = lambda a, b: F.abs(F.col(a) / n_a - F.col(b) / n_b)
    while True:
        binned = cells.join(ranges, "part").withColumn("bin", _bin(F.col("value"), F.col("low"), F.col("factor"), F.col("width")))
        counts = binned.groupBy("part", "bin", "from_a", "from_b").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        along = Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumns({"to_a": F.col("from_a") + F.sum("a").over(along), "to_b": F.col("from_b") + F.sum("b").over(along)})
        ends = stored(ends.withColumns({"from_a": F.col("to_a") - F.col("a"), "from_b": F.col("to_b") - F.col("b")}), "gap-bins")
        best = max(best, ends.agg(F.max(gap("to_a", "to_b"))).first()[0])
        bound = F.greatest(gap("to_a", "from_b"), gap("from_a", "to_b"))
        wide = ends.filter((F.col("lo") < F.col("hi")) & (bound > best))
        factor = F.when(F.col("hi") - F.col("lo") == float("inf"), 0.5).otherwise(1.0)
        numbered = wide.select("part", "bin", F.monotonically_increasing_id().alias("next"), F.col("lo").alias("low"), factor.alias("factor"), (F.col("hi") * factor - F.col("lo") * factor).alias("width"), "from_a", "from_b")
        numbered = stored(numbered, "gap-ranges")
        if numbered.isEmpty():
            return best, n_a, n_b
        cells = stored(binned.select("part", "bin", "value", "a").join(numbered.select("part", "bin", "next"), ["part", "bin"]).select(F.col("next").alias("part"), "value", "a"), "gap-cells")
        ranges = numbered.select(F.col("next").alias("part"), "low", "factor", "width", "from_a", "from_b")

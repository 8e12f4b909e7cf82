"""Distribution drift: PSI on deciles and categories, two-sample Kolmogorov-Smirnov, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import QUANTILES, frequencies, top_values
from plumbline.operators.quantiles import exact_quantiles, largest_gap
from plumbline.session import stored

# Fixed value: empty bins count as this share, so the logarithm stays finite.
FLOOR = 1e-4


def psi_term(expected: Column, actual: Column) -> Column:
    e, a = F.greatest(expected, F.lit(FLOOR)), F.greatest(actual, F.lit(FLOOR))
    return (a - e) * F.log(a / e)


def decile_bins(baseline: DataFrame, column: str) -> DataFrame:
    """One row: the distinct inner decile edges of the baseline and the share each bin holds.

    Deciles are interpolated from the profile's seven quantiles. Tied deciles share an edge and pool
    their mass, so the heavy bin expects what it holds. Edges are rounded to nine
    places, so a value that equals an edge does not change sides with the last bit of the arithmetic.
    """
    wide = exact_quantiles(baseline, [column], QUANTILES).groupBy().pivot("p", list(QUANTILES)).agg(F.max("q"))
    q = {p: F.col(f"`{p}`") for p in QUANTILES}

    def decile(k: int) -> Column:
        share = Fraction(k, 10)
        points = [(p, Fraction(str(p))) for p in QUANTILES]
        (lo, low), (hi, high) = next(pair for pair in zip(points, points[1:], strict=False) if share <= pair[1][1])
        return F.round(q[lo] + (q[hi] - q[lo]) * float((share - low) / (high - low)), 9)

    edges = F.array(*[decile(k) for k in range(1, 10)])
    inner = wide.select(edges.alias("_all"), F.array_distinct(edges).alias("edges"))
    e = lambda k: F.get("_all", F.lit(k))
    middles = [(e(k) + e(k + 1)) / 2.0 for k in range(8)]
    home = lambda x: F.size(F.filter("edges", lambda edge: edge <= x))
    homes = F.array(F.lit(0), *[home(m) for m in middles], F.size("edges"))
    share = F.transform(
        F.sequence(F.lit(0), F.size("edges")),
        lambda b: F.size(F.filter("_homes", lambda h: h == b)) * 0.1,
    )
    return inner.withColumn("_homes", homes).select("edges", share.alias("expected"))


def psi_numeric(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Bins with expected and actual share and their PSI term; the score is the sum of the terms."""
    bins = decile_bins(baseline, column)
    edges = bins.select("edges").scalar()
    x = F.col(column).cast("double")
    usable = current.select(x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = usable.withColumn("_edges", edges).withColumn("bin", F.size(F.filter("_edges", lambda edge: edge <= F.col("_x"))))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    expected = bins.select(F.posexplode("expected").alias("bin", "expected_share"))
    joined = expected.join(counts, "bin", "left")
    actual = F.coalesce(F.col("n"), F.lit(0)) / total
    return joined.select("bin", "expected_share", actual.alias("actual_share"), psi_term(F.col("expected_share"), actual).alias("term"))


def psi_categorical(baseline: DataFrame, current: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Top categories of the baseline plus ``__other__``; shares are of all non-null rows."""
    before = frequencies(baseline, [column])
    now = frequencies(current, [column])
    base_total = before.agg(F.sum("n").alias("t")).scalar()
    now_total = F.greatest(F.coalesce(now.agg(F.sum("n").alias("t")).scalar(), F.lit(0)), F.lit(1))
    top = top_values(before, k).select("value", F.col("n").alias("_b"))
    named = top.join(now.select("value", F.col("n").alias("_n")), "value", "left").select(
        F.col("value").alias("category"), (F.col("_b") / base_total).alias("expected_share"), (F.coalesce("_n", F.lit(0)) / now_total).alias("actual_share")
    )
    rest = named.agg(F.sum("expected_share").alias("_e"), F.sum("actual_share").alias("_a")).select(
        F.lit("__other__").alias("category"),
        F.greatest(F.lit(0.0), 1.0 - F.col("_e")).alias("expected_share"),
        F.greatest(F.lit(0.0), 1.0 - F.col("_a")).alias("actual_share"),
    )
    return named.unionByName(rest).withColumn("term", psi_term(F.col("expected_share"), F.col("actual_share")))


def psi_verdict(bins: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The score and whether it reaches the threshold."""
    return bins.agg(F.sum("term").alias("_s"), F.count(F.lit(1)).alias("bins")).select(
        F.round("_s", 4).alias("score"), "bins", F.when(F.col("_s") >= threshold, 1).otherwise(0).cast("bigint").alias("violation_count")
    )


def ks_two_sample(current: DataFrame, prior: DataFrame, column: str, threshold: float = 0.2) -> DataFrame:
    """The largest gap between two empirical distributions over all rows, with the asymptotic p-value.

    See ``largest_gap``: only value ranges that can hold the gap are looked at closely, and nothing is sorted.
    """
    found = largest_gap(current, prior, column)
    d = current.sparkSession.createDataFrame([found], "statistic double, n_current bigint, n_prior bigint")
    scale = F.sqrt(F.col("n_current") * F.col("n_prior") / (F.col("n_current") + F.col("n_prior"))) * F.col("statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("_l") * F.col("_l")),
    )
    p = F.when(F.col("_l") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    judged = d.withColumn("_l", scale).withColumn("p_value", p)
    enough = (F.col("n_current") >= 2) & (F.col("n_prior") >= 2)
    return judged.select(
        "statistic",
        "p_value",
        "n_current",
        "n_prior",
        F.when(enough & (F.col("p_value") <= threshold), 1).otherwise(0).cast("bigint").alias("violation_count"),
    )


def reservoir_sample(df: DataFrame, column: str, keys: Sequence[str], k: int = 2000) -> DataFrame:
    """``k`` values in the order of a hash of the row's key: the same sample on every run and layout.

    Each task keeps its own top ``k`` before the merge.
    """
    order = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), 256)
    usable = df.filter(F.col(column).isNotNull())
    return usable.select(*keys, F.col(column), order.alias("_h")).orderBy("_h", *keys).limit(k).drop("_h")


SAMPLES = "check_id int, run_id bigint, value double"


def newest_sample(samples: DataFrame, runs: DataFrame, check_id: int) -> DataFrame:
    """The values that a check's newest run without an error kept; ``runs(check_id, run_id, status)``."""
    own = runs.filter((F.col("check_id") == check_id) & (F.col("status") != "error"))
    newest = own.agg(F.max("run_id").alias("run_id"))
    return samples.filter(F.col("check_id") == check_id).join(newest, "run_id").select("value")


def ks_against_prior(
    df: DataFrame, column: str, keys: Sequence[str], check_id: int, run_id: int, samples: DataFrame, runs: DataFrame, threshold: float = 0.2, k: int = 2000
) -> tuple[DataFrame, DataFrame]:
    """A run's verdict against the sample of the run before, and the sample that it leaves for the next one.

    Samples are state: ``k`` values by key hash, written by each run and read by the next. A first run has nothing to
    compare with: it captures its sample and passes (``note``).
    """
    kept = reservoir_sample(df, column, keys, k).select(F.lit(check_id).alias("check_id"), F.lit(run_id).cast("bigint").alias("run_id"), F.col(f"`{column}`").cast("double").alias("value"))
    kept = stored(kept, "drift-sample")
    verdict = ks_two_sample(kept, newest_sample(samples, runs, check_id), "value", threshold)
    first = (F.col("n_current") < 2) | (F.col("n_prior") < 2)
    note = F.when(first, "baseline captured")
    out = verdict.select(
        F.lit(check_id).alias("check_id"), F.lit(run_id).cast("bigint").alias("run_id"), *[F.when(~first, F.col(c)).alias(c) for c in ("statistic", "p_value")], "n_current", "n_prior", "violation_count",
        F.when(F.col("violation_count") > 0, "fail").otherwise("pass").alias("status"), note.alias("note"),
    )
    return out, kept


def bounded_sample(df: DataFrame, keys: Sequence[str], keep: int, out_of: int) -> DataFrame:
    """A fixed share of rows picked by a hash of the key; a filter, so no shuffle."""
    digest = F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), 256), 1, 8)
    return df.filter(F.conv(digest, 16, 10).cast("bigint") % out_of < keep)

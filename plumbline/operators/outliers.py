"""Outliers: z-scores, and an isolation forest trained on small hashed samples and scored on every row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.schemachecks import column_kind
from plumbline.session import stored

TREES = 200
SAMPLE = 256
MIN_ROWS = 50
EULER = 0.5772156649015329


def zscore_outliers(df: DataFrame, column: str, limit: float = 4.0) -> DataFrame:
    """Rows further than ``limit`` sample deviations from the mean; the two moments are scalar subqueries."""
    x = F.col(column).cast("double")
    moments = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    z = (x - moments.select("m").scalar()) / F.nullif(moments.select("s").scalar(), F.lit(0.0))
    return df.withColumn("z", z).filter(F.abs("z") > limit)


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    safe = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe, out)


def _grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    """One isolation tree as flat arrays; a leaf has feature -1 and its expected remaining depth as value."""
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": []}

    def add(feature: int, cut: float) -> int:
        for name, value in (("feature", feature), ("cut", cut), ("left", -1), ("right", -1)):
            tree[name].append(value)
        return len(tree["feature"]) - 1

    def split(rows: np.ndarray, depth: int) -> int:
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or len(usable) == 0:
            return add(-1, depth + float(_path_length(len(rows))))
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        node = add(feature, cut)
        mask = rows[:, feature] <= cut
        tree["left"][node] = split(rows[mask], depth + 1)
        tree["right"][node] = split(rows[~mask], depth + 1)
        return node

    split(points, 0)
    return tree


def _depths(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while True:
        feature = tree["feature"][node]
        live = feature >= 0
        if not live.any():
            return tree["cut"][node]
        at = node[live]
        below = points[rows[live], feature[live]] <= tree["cut"][at]
        node[live] = np.where(below, tree["left"][at], tree["right"][at])


def _spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hash the rows over all shuffle partitions: the Python work per row outweighs the shuffle by far, and
    a fixed number keeps adaptive execution from merging partitions that are small in bytes only."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by)


def prepare(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str], int]:
    """Standardised features: missing and infinite cells become the column's median, constant columns go.

    Only a few numbers per column reach the driver.
    """
    wanted = list(columns) if columns else [f.name for f in df.schema.fields if column_kind(f.dataType) == "numeric" and f.name not in keys]

    def clean(name: str):  # noqa: ANN202
        x = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)

    base = df.select(*keys, *[clean(c).alias(c) for c in wanted])
    bounds = base.agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(wanted)], *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(wanted)]).first()
    features = [c for i, c in enumerate(wanted) if bounds[f"_lo{i}"] is not None and bounds[f"_hi{i}"] > bounds[f"_lo{i}"]]
    rows = bounds["_n"]
    if not features or rows < MIN_ROWS:
        return base, [], rows
    # One median per column: as many rows as the table has numeric columns.
    medians = {r["column_name"]: r["q"] for r in exact_quantiles(base, features, [0.5]).collect()}
    filled = base.select(*keys, *[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in features])
    stats = filled.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(features)]).first()
    scaled = filled.select(
        *keys, *[((F.col(c) - stats[f"_m{i}"]) / (stats[f"_s{i}"] or 1.0)).alias(c) for i, c in enumerate(features)]
    )
    return scaled, features, rows


def train(scaled: DataFrame, keys: Sequence[str], features: Sequence[str], rows: int, seed: int = 42) -> list[dict[str, Any]]:
    """Grow the trees on executors, each from about SAMPLE rows chosen by key hash.

    A row joins as many trees as it takes to fill them all; the chance falls with the table's size, so the
    training set stays about TREES × SAMPLE rows. The trees (flat arrays, bounded by the two constants)
    come back to the driver.
    """
    target = TREES * SAMPLE * 1.25
    copies = int(min(TREES, max(1, np.ceil(target / rows))))
    share = min(1.0, target / (rows * copies))
    key = [F.col(k).cast("string") for k in keys]
    drawn = scaled.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed), *key, F.col("_j")))
    kept = drawn.filter(F.pmod("_h", F.lit(1_000_003)) < int(share * 1_000_003))
    placed = kept.withColumn("tree", F.pmod(F.xxhash64(F.lit(seed + 1), *key, F.col("_j")), F.lit(TREES)).cast("int"))
    names = list(features)
    depth = int(np.ceil(np.log2(SAMPLE)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        picked = pdf.sort_values("_h").head(SAMPLE)
        number = int(pdf["tree"].iloc[0])
        tree = _grow(picked[names].to_numpy(), np.random.default_rng(seed + number), depth)
        return pd.DataFrame({"tree": [number], "size": [len(picked)], **{k: [v] for k, v in tree.items()}})

    schema = "tree int, size int, feature array<int>, cut array<double>, left array<int>, right array<int>"
    grown = _spread(placed.select("tree", "_h", *names), ["tree"]).groupBy("tree").applyInPandas(build, schema).orderBy("tree").collect()
    return [
        {
            "size": r["size"],
            "feature": np.array(r["feature"], dtype=np.int64),
            "cut": np.array(r["cut"], dtype=float),
            "left": np.array(r["left"], dtype=np.int64),
            "right": np.array(r["right"], dtype=np.int64),
        }
        for r in grown
    ]


def isolation_scores(scaled: DataFrame, keys: Sequence[str], features: Sequence[str], trees: list[dict[str, Any]]) -> DataFrame:
    """Anomaly score in (0, 1] of every row; higher is stranger. Columns travel as Arrow batches."""
    shipped = scaled.sparkSession.sparkContext.broadcast(trees)
    norm = float(np.mean(_path_length(np.array([t["size"] for t in trees]))))
    names, ids = list(features), list(keys)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            points = part[names].to_numpy()
            depth = np.zeros(len(points))
            for tree in shipped.value:
                depth += _depths(tree, points)
            yield part[ids].assign(score=np.power(2.0, -depth / len(shipped.value) / norm))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema.fields if f.name in set(ids))
    return scaled.mapInPandas(score, f"{fields}, score double")


def isolation_outliers(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, contamination: float = 0.005
) -> DataFrame:
    """All rows whose isolation score lies beyond the contamination quantile, strangest first.

    All rows are scored. A forest needs 50 rows and a column that varies; without them the one row of the result has
    null keys and ``status`` says why, while flagged rows have the status ``outlier``.
    """
    scaled, features, rows = prepare(df, keys, columns)
    if not features:
        why = "not enough rows" if rows < MIN_ROWS else "no column varies"
        nothing = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        return df.sparkSession.range(1).select(*nothing, F.lit(None).cast("double").alias("score"), F.lit(why).alias("status"))
    trees = train(scaled, keys, features, rows)
    # Scoring is the costly part and both the threshold and the filter need it: write it once.
    scores = stored(isolation_scores(scaled, keys, features, trees), "isolation-scores")
    share = 1.0 - min(max(contamination, 1e-4), 0.5)
    threshold = exact_quantiles(scores, ["score"], [share]).select("q").scalar()
    return scores.filter(F.col("score") > threshold).withColumn("status", F.lit("outlier")).orderBy(F.desc("score"), *keys)

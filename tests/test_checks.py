"""Checks on a table with planted defects, whose counts are known."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drift, historychecks, localize, outliers, profile, quantiles, rowchecks, schemachecks, suite, tablechecks
from plumbline.operators.quantiles import exact_quantiles, largest_gap
from plumbline.operators.spec import CheckSpec, register_check
from plumbline.sources import workbench

NOW = datetime(2024, 6, 1, 12)


@pytest.fixture(scope="module")
def people(spark: SparkSession) -> DataFrame:
    rows = []
    for i in range(1, 201):
        email = None if i <= 5 else {6: "not-an-email", 7: "a@b", 9: "user8@example.com"}.get(i, f"user{i}@example.com")
        age = 999 if i == 10 else 18 + i % 48
        status = "x" if i == 11 else ("active" if i % 2 else "inactive")
        created = NOW + timedelta(days=10) if i == 12 else NOW - timedelta(hours=2, minutes=i)
        rows.append((i, email, age, status, 50.0 + i % 10, created))
    return spark.createDataFrame(rows, "id int, email string, age int, status string, score double, created_at timestamp_ntz").cache()


@pytest.mark.parametrize(
    ("kind", "column", "params", "expected"),
    [
        ("not_null", "email", {}, 5),
        ("accepted_values", "status", {"values": ["active", "inactive"]}, 1),
        ("accepted_values", "status", {"values": ["ACTIVE", "Inactive", "X"], "case_sensitive": False}, 0),
        ("range", "age", {"min": 0, "max": 120}, 1),
        ("string_length", "status", {"min_len": 6}, 1),
        ("regex_match", "email", {"pattern": r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$"}, 2),
        ("regex_match", "email", {"pattern": "example"}, 2),
        ("regex_match", "email", {"pattern": "example", "anchored": True}, 195),
    ],
)
def test_row_checks(people: DataFrame, kind: str, column: str, params: dict, expected: int) -> None:
    spec = CheckSpec(1, kind, column, params)
    result = rowchecks.check_result(people, spec).first()
    assert (result["rows_evaluated"], result["violation_count"]) == (200, expected)
    assert result["status"] == ("pass" if expected == 0 else "fail")
    bad = rowchecks.violations(people, spec)
    assert bad.count() == expected
    assert people.filter(rowchecks.healthy_predicate(spec)).count() == 200 - expected
    assert bad.filter(F.col("reason").isNull()).count() == 0


def test_unique_counts_the_surplus(people: DataFrame) -> None:
    row = tablechecks.unique_counts(people, "email").first()
    assert (row["violation_count"], row["duplicate_groups"], row["duplicated_rows"], row["rows_evaluated"]) == (1, 1, 2, 200)
    assert {r["id"] for r in tablechecks.duplicate_samples(people, "email").collect()} == {8, 9}


def test_freshness_ignores_future_rows(people: DataFrame) -> None:
    for limit, stale in ((1, 1), (100, 0)):
        row = tablechecks.freshness(people, "created_at", NOW, limit).first()
        assert (row["violation_count"], row["future_rows"]) == (stale, 1)
    only_future = people.filter("id = 12")
    assert tablechecks.freshness(only_future, "created_at", NOW, 100).first()["violation_count"] == 1


def test_suite_equals_single_runs(people: DataFrame) -> None:
    specs = [
        CheckSpec(1, "not_null", "email", severity="warn"),
        CheckSpec(2, "range", "age", {"max": 120}, tolerance=1),
        CheckSpec(3, "unique", "email", severity="info"),
        CheckSpec(4, "range", "nowhere", {"max": 1}),
        CheckSpec(5, "freshness", "created_at", {"max_age_hours": 1}),
    ]
    rows = {r["check_id"]: r for r in suite.run_suite(people, specs, NOW).collect()}
    assert [rows[i]["status"] for i in range(1, 6)] == ["warn", "pass", "warn", "error", "fail"]
    assert rows[1]["violation_count"] == rowchecks.check_result(people, specs[0]).first()["violation_count"]
    assert rows[5]["rows_evaluated"] is None


def test_registered_and_sql_checks(people: DataFrame) -> None:
    register_check("all_bad", lambda df, spec, history: df, needs_column=False)
    sql = CheckSpec(2, "custom_sql", params={"sql": "SELECT * FROM source WHERE age > :a", "args": {"a": 100}})
    rows = {r["check_id"]: r["violation_count"] for r in suite.run_suite(people, [CheckSpec(1, "all_bad"), sql]).collect()}
    assert rows == {1: 200, 2: 1}
    assert workbench.sql_violations(people, sql).count() == 1


@pytest.mark.parametrize(("kind", "column", "params"), [("range", "a", {}), ("regex_match", "a", {}), ("not_null", None, {}), ("nothing", "a", {})])
def test_bad_specs_are_refused(kind: str, column: str | None, params: dict) -> None:
    with pytest.raises(ValueError):
        CheckSpec(1, kind, column, params)


def _runs(spark: SparkSession, counts: list[int]) -> DataFrame:
    rows = [(1, datetime(2024, 1, 1) + timedelta(days=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "k int, at timestamp_ntz, n bigint")


def test_volume_checks_flag_a_jump(spark: SparkSession) -> None:
    runs = _runs(spark, [100, 101, 100, 99, 100, 200])
    adaptive = historychecks.volume_adaptive(runs, "k", ["at"], "n", F.to_date("at")).orderBy("at").collect()
    assert [r["violation_count"] for r in adaptive] == [0, 0, 0, 0, 0, 1]
    assert adaptive[-1]["baseline_center"] == 100.0
    sigma = historychecks.volume_sigma(runs, "k", ["at"], "n", F.to_date("at")).orderBy("at").collect()
    assert [r["violation_count"] for r in sigma] == [0, 0, 0, 0, 0, 1]
    assert sigma[-1]["std"] == 1.0


def test_adaptive_freshness_learns_the_interval(spark: SparkSession) -> None:
    at = [NOW - timedelta(hours=h) for h in (18, 12, 6)]
    runs = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "k int, run int, latest timestamp_ntz")
    row = historychecks.adaptive_max_age(runs, "k", ["run"], "latest", 48.0, multiplier=0.5).first()
    assert (row["max_age_hours"], row["threshold_source"], row["history_n"]) == (3.0, "history", 3)
    short = historychecks.adaptive_max_age(runs.limit(2), "k", ["run"], "latest", 48.0).first()
    assert (short["max_age_hours"], short["threshold_source"]) == (48.0, "default")


def test_schema_contract_differences(spark: SparkSession) -> None:
    kinds = "name string, dtype string, nullable boolean"
    expected = spark.createDataFrame([("id", "INTEGER", False), ("email", None, None), ("status", None, None)], kinds)
    current = spark.createDataFrame([("id", "BIGINT", True), ("status", "text", True), ("loaded_at", "ts", True)], kinds)
    strict = schemachecks.contract_diff(expected, current, allow_additive=False)
    assert strict.filter("violation").count() == 4
    assert {r["change"] for r in strict.collect()} == {"type_changed", "nullability_changed", "missing", "added"}
    assert schemachecks.contract_diff(expected, current).filter("violation").count() == 3


def test_schema_snapshots(spark: SparkSession) -> None:
    shape = "d int, v int, is_baseline boolean, columns array<struct<ordinal:int,name:string,dtype:string,nullable:boolean>>"
    a, b = [(0, "id", "int", False), (1, "x", "int", True)], [(0, "id", "int", False), (1, "x", "string", True), (2, "y", "int", True)]
    moved = [(0, "x", "string", True), (1, "id", "int", False), (2, "y", "int", True)]
    snaps = spark.createDataFrame([(1, 1, True, a), (1, 2, False, a), (1, 3, False, b), (1, 4, False, moved)], shape)
    chunk = F.floor(F.col("v") / 2)
    kept = schemachecks.drop_repeated_snapshots(snaps, "d", ["v"], chunk)
    assert sorted(r["v"] for r in kept.collect()) == [1, 3, 4]
    changes = schemachecks.schema_changes(snaps, "d", ["v"], chunk).collect()
    assert {(r["v"], r["change_type"], r["column_name"], r["alerting"]) for r in changes} == {
        (3, "type_changed", "x", True), (3, "added", "y", False), (4, "reordered", None, False),
    }
    pinned = schemachecks.against_pinned(snaps, "d", "v").collect()
    assert {(r["change_type"], r["column_name"]) for r in pinned} == {("type_changed", "x"), ("added", "y")}
    assert schemachecks.append_snapshot(kept, snaps.filter("v = 4"), "d", ["v"]).count() == 0
    assert schemachecks.append_snapshot(kept, snaps.filter("v = 1"), "d", ["v"]).count() == 1


def test_psi_tells_shifted_from_stable(spark: SparkSession) -> None:
    def normal(mean: float, seed: int) -> DataFrame:
        return spark.range(4000).select((F.randn(seed) + mean).alias("v"))

    base = normal(0, 1)
    assert drift.psi_verdict(drift.psi_numeric(base, normal(0, 2), "v")).first()["score"] < 0.1
    shifted = drift.psi_verdict(drift.psi_numeric(base, normal(3, 3), "v")).first()
    assert shifted["score"] > 0.2 and shifted["violation_count"] == 1


def test_psi_pools_tied_deciles(spark: SparkSession) -> None:
    zeros = spark.range(1000).select(F.when(F.col("id") < 700, 0.0).otherwise((F.col("id") % 30 + 1).cast("double")).alias("v"))
    shifted = spark.range(1000).select((F.col("id") + 100).cast("double").alias("v"))
    bins = drift.psi_numeric(zeros, zeros, "v").collect()
    assert sum(r["expected_share"] for r in bins) == pytest.approx(1.0)
    assert max(r["expected_share"] for r in bins) > 1.5 / len(bins)
    score = lambda other: drift.psi_verdict(drift.psi_numeric(zeros, other, "v")).first()["score"]
    assert score(zeros) < score(shifted)


def test_psi_of_categories(spark: SparkSession) -> None:
    def mix(**counts: int) -> DataFrame:
        return spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "v string")

    base = mix(a=600, b=300, c=100)
    assert drift.psi_verdict(drift.psi_categorical(base, mix(a=590, b=305, c=105), "v")).first()["violation_count"] == 0
    assert drift.psi_verdict(drift.psi_categorical(mix(a=400, b=400, c=200), mix(a=990, d=10), "v")).first()["violation_count"] == 1


def test_ks_over_bands(spark: SparkSession) -> None:
    a = spark.range(3000).select(F.randn(1).alias("v"))
    b = spark.range(3000).select((F.randn(2) + 4).alias("v"))
    moved = drift.ks_two_sample(b, a, "v").first()
    assert moved["statistic"] > 0.9 and moved["violation_count"] == 1
    same = drift.ks_two_sample(a, a, "v").first()
    assert same["statistic"] == 0.0 and same["violation_count"] == 0


def test_quantiles_equal_sorted_values(spark: SparkSession) -> None:
    # A third of all rows holds one value; NaN and NULL do not count.
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50 == 1, float("nan")).when(F.col("id") % 50 != 2, F.rand(5) * 100)
    df = spark.range(20000).select(x.alias("x"), (F.col("id") % 11).alias("k")).cache()
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    assert df.filter("x is not null and not isnan(x)").select("x").distinct().count() > 4096  # several values in each band
    banded = {(r["column_name"], r["p"]): r["q"] for r in exact_quantiles(df, ["x", "k"], probs).collect()}
    whole = df.select(*[F.percentile(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), probs).alias(c) for c in ("x", "k")]).first()
    buffered = {(c, p): q for c in ("x", "k") for p, q in zip(probs, whole[c], strict=True)}
    assert banded.keys() == buffered.keys() and len(banded) == 10
    for key, value in buffered.items():
        assert banded[key] == pytest.approx(value, abs=1e-9)


def test_profile(people: DataFrame) -> None:
    rows = {r["column_name"]: r for r in profile.profile(people).collect()}
    assert rows["email"]["null_count"] == 5 and rows["email"]["distinct_count"] == 194
    assert rows["email"]["email"] > 0.95 and rows["age"]["max_number"] == 999.0
    assert rows["status"]["top_values"][0]["value"] in ("active", "inactive")
    assert rows["score"]["quantiles"]["0.5"] == 54.5
    keys = profile.key_candidates(profile.column_facts(people), profile.distinct_counts(profile.frequencies(people)))
    assert {r["column_name"] for r in keys.collect()} == {"id", "created_at"}


def test_long_texts_are_told_apart_to_the_end(spark: SparkSession) -> None:
    stem = "x" * 5000
    df = spark.createDataFrame([(stem + "a",), (stem + "a",), (stem + "b",), ("short",)], "t string")
    assert profile.distinct_counts(profile.frequencies(df)).first()["distinct_count"] == 3
    top = profile.restore_long_values(df, profile.top_values(profile.frequencies(df), 1)).first()
    assert (top["value"], top["n"]) == (stem + "a", 2)


def test_forest_ranks_planted_outliers_first(spark: SparkSession) -> None:
    planted = F.col("id").isin(50, 200, 400)
    df = spark.range(600).select(
        "id",
        F.when(planted, 5000.0).otherwise(100 + 8 * F.randn(1)).alias("amount"),
        F.when(planted, 80.0).otherwise(3 + 0.5 * F.randn(2)).alias("quantity"),
        F.lit(1.0).alias("flat"),
    ).cache()
    found = outliers.isolation_outliers(df, ["id"], contamination=0.01).collect()
    assert {r["id"] for r in found[:3]} == {50, 200, 400}
    assert outliers.prepare(df, ["id"])[1] == ["amount", "quantity"]
    assert [tuple(r) for r in outliers.isolation_outliers(df.limit(20), ["id"]).collect()] == [(None, None, "not enough rows")]
    flagged = outliers.isolation_outliers(spark.range(40_000).select("id", F.rand(3).alias("x")), ["id"], contamination=0.02)
    assert flagged.count() > 500  # about two in a hundred, without a cap
    assert {r["id"] for r in outliers.zscore_outliers(df, "amount").collect()} == {50, 200, 400}


def test_attribution_finds_the_culprit(spark: SparkSession) -> None:
    df = spark.range(1000).select(
        (F.col("id") % 4 == 0).alias("bad"), F.when(F.col("id") % 4 == 0, "eu").otherwise("us").alias("region"), (F.col("id") % 7).alias("k"), F.lit("s").alias("secret")
    )
    top = localize.attribution_factors(df, F.col("bad"), ["region", "k", "secret"], pii=["SECRET"]).collect()
    assert (top[0]["column_name"], top[0]["value"], top[0]["fail_count"], top[0]["healthy_count"]) == ("region", "eu", 250, 0)
    assert all(r["column_name"] != "secret" for r in top)


def test_quantiles_of_awkward_columns(spark: SparkSession) -> None:
    """Hot values, outliers that leave one bin, the widest range of doubles, denormals, infinities and no values."""
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(5000) < 0.9, 7.0, rng.normal(0, 1, 5000))
    far = np.concatenate([rng.normal(0, 1e-9, 4999), [1e300]])
    wide = np.concatenate([rng.uniform(-1, 1, 4998) * 1.7e308, [-1.7976931348623157e308, 1.7976931348623157e308]])
    tiny = rng.integers(0, 50, 5000) * 5e-324
    columns = {"hot": hot, "far": far, "wide": wide, "tiny": tiny, "some": np.where(rng.random(5000) < 0.5, np.nan, rng.integers(0, 9, 5000))}
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumns({"none": F.lit(None).cast("double"), "inf": F.when(F.col("hot") == 7, float("inf")).otherwise(F.lit(-0.0))})
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column_name"], r["p"]): r["q"] for r in exact_quantiles(df, df.columns, probs).collect()}
    assert {c for c, _ in got} == {*columns, "inf"}
    for name, values in columns.items():
        ordered = np.sort(values[~np.isnan(values)])
        for p in probs:
            at = p * (len(ordered) - 1)
            low, high = float(ordered[math.floor(at)]), float(ordered[math.ceil(at)])
            assert got[name, p] == low + (high - low) * (at - math.floor(at)), (name, p)
    assert got["inf", 0.5] == 0.0


@pytest.mark.parametrize("kind", ["same", "shifted", "ties", "infinite", "far"])
def test_gap_equals_sorted_values(spark: SparkSession, kind: str) -> None:
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 3000), rng.normal(0.3 if kind == "shifted" else 0, 1, 2000)
    if kind == "ties":
        a, b = np.round(a), np.round(b * 2)
    if kind == "infinite":
        a, b = np.where(rng.random(3000) < 0.3, -np.inf, a), np.where(rng.random(2000) < 0.1, np.inf, b)
    if kind == "far":
        a, b = np.append(a * 1e-12, 1e250), np.append(b * 1e-12, -1e250)
    cells = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).sum() / len(a) - (b <= x).sum() / len(b)) for x in cells)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    assert largest_gap(frame(a), frame(b), "v") == (want, len(a), len(b))
    assert largest_gap(frame(a), frame([]), "v") == (None, len(a), 0)


def test_no_window_over_values_in_ks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A window sees one range's bins: at most ``BINS`` rows, however many values there are."""
    seen: list[int] = []
    keep = quantiles.stored

    def look(df: DataFrame, purpose: str) -> DataFrame:
        out = keep(df, purpose)
        if purpose == "gap-bins":
            seen.append(out.groupBy("part").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "stored", look)
    half = spark.range(40_000).select((F.sin("id") * 1000).alias("v"))
    assert largest_gap(half, half, "v")[0] == 0.0
    assert seen and max(seen) <= quantiles.BINS

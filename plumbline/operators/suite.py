"""Run many checks on one table in one scan, over the whole table or per time slice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import run_status
from plumbline.operators import drift, historychecks, outliers, schemachecks
from plumbline.operators.rowchecks import ROW_CHECKS, count_where, violation_predicate
from plumbline.operators.schemachecks import column_kind
from plumbline.operators.spec import CHECK_TYPES, CheckSpec
from plumbline.operators.tablechecks import freshness, member_counts, unique_counts
from plumbline.sources import workbench

RESULT = "check_id int, check_type string, column_name string, severity string, rows_evaluated bigint, violation_count bigint, status string, detail string"


Given = DataFrame | None
#: Accepted values beyond this number are joined as a table.
LONG_LIST = 1000


def _kind(df: DataFrame, spec: CheckSpec) -> str | None:
    return next((column_kind(f.dataType) for f in df.schema.fields if f.name == spec.column), None)


def by_dictionary(spec: CheckSpec) -> bool:
    """Whether a check compares with a table of values: a long list in an expression would be compiled into every task."""
    return spec.check_type == "accepted_values" and (spec.params.get("values_from") is not None or len(spec.params["values"]) > LONG_LIST)


def dictionary(df: DataFrame, spec: CheckSpec, given: Given) -> DataFrame:
    """The accepted values as a table: the given one (``values_from``), or the list."""
    if spec.params.get("values_from") is not None:
        return _needed(given)
    return df.sparkSession.createDataFrame([(v,) for v in spec.params["values"]], ["value"])


def row_predicate(df: DataFrame, spec: CheckSpec) -> tuple[Column, Column | None] | None:
    """Where a row violates a row check, and where its cell cannot be judged; None for other checks.

    A cast that fails would end the scan for all checks. Text is cast on trial instead, and a check with cells
    that do not fit becomes an error of its own.
    """
    value, kind, params = F.col(f"`{spec.column}`"), _kind(df, spec), spec.params
    if by_dictionary(spec):
        return None
    if spec.check_type == "range" and kind == "string" and not any(isinstance(params.get(p), str) for p in ("min", "max")):
        number = value.try_cast("double")
        low, high = params.get("min"), params.get("max")
        outside = F.lit(False) if low is None else number < float(low)
        outside = outside if high is None else outside | (number > float(high))
        return outside, value.isNotNull() & number.isNull()
    if spec.check_type == "accepted_values" and kind not in (None, "string") and any(isinstance(v, str) for v in params["values"]):
        return value.isNotNull() & ~value.cast("string").isin(*map(str, params["values"])), None
    return (violation_predicate(spec), None) if spec.check_type in ROW_CHECKS else None


def _fused(df: DataFrame, spec: CheckSpec, as_of: datetime | None) -> tuple[Column, Column | None] | None:
    """The check's violation count as an aggregate of the shared scan, and a count of cells that cannot be judged."""
    value, params = F.col(f"`{spec.column}`"), spec.params
    by_row = row_predicate(df, spec)
    if by_row is not None:
        bad, unfit = by_row
        return count_where(bad), None if unfit is None else count_where(unfit)
    if spec.check_type == "row_count_min":
        low = F.count(F.lit(1)) < int(params.get("min_rows", 1))
        return F.when(low, 1).otherwise(0).cast("bigint"), None
    if spec.check_type == "freshness" and params.get("strategy", "static") == "static" and as_of is not None:
        now = F.lit(as_of).cast("timestamp_ntz")
        stamp = value.try_cast("timestamp_ntz")
        latest = F.max(F.when(stamp <= now, stamp))
        age = F.timestamp_diff("SECOND", latest, now) / 3600.0
        stale = latest.isNull() | (age > float(params.get("max_age_hours", 24)))
        return F.when(stale, 1).otherwise(0).cast("bigint"), count_where(value.isNotNull() & stamp.isNull())
    return None


def _members(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    """``given`` is the table of accepted values, its first column."""
    return member_counts(df, spec.column, dictionary(df, spec, given), spec.params.get("case_sensitive", True))


def _unique(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    return unique_counts(df, spec.column)


def contract_breaks(df: DataFrame, spec: CheckSpec) -> DataFrame:
    """Differences from the expected columns, each given as (name, type, nullable) or by these names; what is missing is free."""
    wanted = [(c["name"], c.get("dtype"), c.get("nullable")) if isinstance(c, Mapping) else tuple(c) for c in spec.params["expected_columns"]]
    expected = df.sparkSession.createDataFrame(wanted, "name string, dtype string, nullable boolean")
    return schemachecks.contract_diff(expected, schemachecks.column_catalog({"": df}), spec.params.get("allow_additive", True), spec.params.get("case_sensitive", False))


def _contract(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    return contract_breaks(df, spec).agg(count_where(F.col("violation")).alias("violation_count"))


def _schema_change(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    """``given`` is the baseline: name, dtype, nullable."""
    return schemachecks.contract_diff(_needed(given), schemachecks.column_catalog({"": df})).agg(count_where(F.col("violation")).alias("violation_count"))


def _drift(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    """``given`` is the baseline's rows."""
    limit = float(spec.params.get("threshold", 0.2))
    if spec.params.get("method") == "ks":
        return drift.ks_two_sample(df, _needed(given), spec.column, limit)
    psi = drift.psi_numeric if _kind(df, spec) == "numeric" else drift.psi_categorical
    return drift.psi_verdict(psi(_needed(given), df, spec.column), limit)


def _outliers(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    found = outliers.isolation_outliers(df, spec.params.get("keys") or df.columns, spec.params.get("columns"), float(spec.params.get("contamination", 0.005)))
    return found.agg(F.count_if(F.col("status") == "outlier").alias("violation_count"))


def _volume(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    """``given`` is the history: run_id, rows_evaluated. The table's own count is judged as the run after it."""
    now = df.agg(F.count(F.lit(1)).alias("rows_evaluated")).select(F.lit(True).alias("now"), F.lit(None).cast("bigint").alias("run_id"), "rows_evaluated")
    runs = _needed(given).select(F.lit(False).alias("now"), F.col("run_id").cast("bigint").alias("run_id"), F.col("rows_evaluated").cast("bigint").alias("rows_evaluated"))
    both = runs.unionByName(now).withColumn("dataset", F.lit(1))
    judge = historychecks.volume_adaptive if spec.params.get("strategy") == "adaptive" else historychecks.volume_sigma
    tuned = {k: spec.params[k] for k in ("lookback_runs", "min_history", "sigma", "multiplier") if k in spec.params}
    return judge(both, "dataset", ["now", "run_id"], "rows_evaluated", F.col("now").cast("int"), **tuned).filter("now").select("rows_evaluated", "violation_count")


def _freshness(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    """``given`` is the history: run_id, latest. Without one the default age holds."""
    if as_of is None:
        raise ValueError("freshness needs as_of")
    tuned = {k: spec.params[k] for k in ("lookback_runs", "min_history", "multiplier", "grace_hours") if k in spec.params}
    default = float(spec.params.get("default_max_age_hours", spec.params.get("max_age_hours", 24)))
    if given is None:
        return freshness(df, spec.column, as_of, default)
    history = given.withColumn("dataset", F.lit(1))
    learned = historychecks.adaptive_max_age(history, "dataset", ["run_id"], "latest", default, **tuned)
    return freshness(df, spec.column, as_of, learned.select("max_age_hours").scalar())


def _sql(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> DataFrame:
    return workbench.sql_violations(df, spec).agg(F.count(F.lit(1)).alias("violation_count"))


def _needed(given: Given) -> DataFrame:
    if given is None:
        raise ValueError("no baseline or history was given")
    return given


#: Check types that take a pass of their own. Each returns one row with ``violation_count``.
ALONE: dict[str, Callable[[DataFrame, CheckSpec, Given, datetime | None], DataFrame]] = {
    "unique": _unique, "accepted_values": _members, "schema_contract": _contract, "schema_change": _schema_change, "distribution_drift": _drift, "ml_outlier": _outliers, "row_count_anomaly": _volume, "freshness": _freshness, "custom_sql": _sql,
}


def _line(spec: CheckSpec, rows: Column, violations: Column, error: str | None = None, unfit: Column | None = None) -> Column:
    status = F.lit("error") if error else run_status(violations, F.lit(spec.tolerance), F.lit(spec.severity))
    detail = F.lit(error).cast("string")
    if unfit is not None:
        status = F.when(unfit > 0, "error").otherwise(status)
        violations = F.when(unfit == 0, violations)
        detail = F.when(unfit > 0, F.concat(F.lit("CAST_INVALID_INPUT: "), unfit.cast("string"), F.lit(" cells")))
    return F.struct(
        F.lit(spec.check_id).cast("int").alias("check_id"),
        F.lit(spec.check_type).alias("check_type"),
        F.lit(spec.column).cast("string").alias("column_name"),
        F.lit(spec.severity).alias("severity"),
        rows.cast("bigint").alias("rows_evaluated"),
        violations.cast("bigint").alias("violation_count"),
        status.alias("status"),
        detail.alias("detail"),
    )


def _resolves(df: DataFrame, measure: Column) -> str | None:
    """The analyser's complaint about a measure, or None. No job runs."""
    try:
        df.agg(measure)
    except AnalysisException as failure:
        return f"{type(failure).__name__}: {failure.getCondition()}"
    return None


def _named(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure.getCondition()}" if isinstance(failure, PySparkException) else f"{type(failure).__name__}: {failure}"


def run_suite(
    df: DataFrame, specs: Sequence[CheckSpec], as_of: datetime | None = None, by: Sequence[Column] = (), given: Mapping[int, DataFrame] | None = None
) -> DataFrame:
    """One result row per check (and per value of ``by``).

    All row, volume and static freshness checks become aggregates of one pass. Every other type is a job of its own,
    run here; ``given`` holds its baseline or history by check id. A check that does not resolve, meets cells that
    do not fit, or fails while it runs, turns into an ``error`` row and leaves the others alone.
    """
    shared, alone = split(df, specs, as_of)
    if by and alone:
        raise ValueError(f"not available per slice: {', '.join(s.check_type for s in alone)}")
    grouped = df.groupBy(*by) if by else df.groupBy()
    counts = grouped.agg(*shared.measures())
    out = shared.results(counts, counts.columns[: len(by)])
    results = [_alone(df, spec, (given or {}).get(spec.check_id), as_of) for spec in alone]
    if results:
        extra = df.sparkSession.createDataFrame(results, RESULT)
        out = extra if out is None else out.unionByName(extra)
    return out


@dataclass
class Shared:
    """The checks that are aggregates of one scan, and those of them that do not resolve."""

    good: list[tuple[CheckSpec, Column, Column | None]]
    bad: list[tuple[CheckSpec, str]]

    def measures(self) -> list[Column]:
        counts = [m.alias(f"_v{i}") for i, (_, m, _) in enumerate(self.good)] + [u.alias(f"_u{i}") for i, (_, _, u) in enumerate(self.good) if u is not None]
        return [F.count(F.lit(1)).alias("_rows"), *counts]

    def results(self, counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame | None:
        """A result row per check from the measured values."""
        none = F.lit(None).cast("bigint")
        rows_of = lambda spec: none if spec.check_type == "freshness" else F.col("_rows")
        lines = [_line(s, rows_of(s), F.col(f"_v{i}"), unfit=None if u is None else F.col(f"_u{i}")) for i, (s, _, u) in enumerate(self.good)]
        lines += [_line(s, none, none, why) for s, why in self.bad]
        return counts.select(*keep, F.explode(F.array(*lines)).alias("_r")).select(*keep, "_r.*") if lines else None


def split(df: DataFrame, specs: Sequence[CheckSpec], as_of: datetime | None) -> tuple[Shared, list[CheckSpec]]:
    """The checks that share a scan, and those that take a pass of their own."""
    shared, alone = Shared([], []), []
    for spec in specs:
        measure = _fused(df, spec, as_of)
        if measure is None:
            alone.append(spec)
            continue
        problem = _resolves(df, measure[0])
        shared.bad.append((spec, problem)) if problem else shared.good.append((spec, *measure))
    return shared, alone


def _alone(df: DataFrame, spec: CheckSpec, given: Given, as_of: datetime | None) -> tuple:
    head = (spec.check_id, spec.check_type, spec.column, spec.severity)
    run, custom = ALONE.get(spec.check_type), CHECK_TYPES[spec.check_type].violations
    try:
        if run is None and custom is None:
            raise ValueError("the check type has no way to run")
        found = run(df, spec, given, as_of) if run else custom(df, spec, given).agg(F.count(F.lit(1)).alias("violation_count"))
        rows = F.col("rows_evaluated") if "rows_evaluated" in found.columns else F.lit(None)
        status = run_status(F.col("violation_count"), F.lit(spec.tolerance), F.lit(spec.severity))
        row = found.select(rows.cast("bigint").alias("r"), F.col("violation_count").cast("bigint").alias("v"), status.alias("s")).first()
        return (*head, row["r"], row["v"], row["s"], None)
    except (PySparkException, Py4JError, ValueError, KeyError, TypeError) as failure:
        return (*head, None, None, "error", _named(failure))

"""One run of a suite from end to end: results, violating rows, exception state, incidents.

The violating rows of all fused checks are written by one job, and the same scan measures the checks: the counts are
observed metrics of the write (``DataFrame.observe``), so the table is read once however many checks there are. Checks
that take a pass of their own bring a measure and, where single rows are to blame, a plan of their violating rows.
Nothing is sampled: the exception state sees every violating row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions.fingerprint import packed, row_fingerprint, unpacked
from plumbline.operators import incidents, outliers, reconcile, schemachecks, suite, tablechecks
from plumbline.operators.rowchecks import reason
from plumbline.operators.spec import CHECK_TYPES, CheckSpec
from plumbline.session import stored

STATE = """check_id int, fingerprint string, dataset_id bigint, run_id bigint, last_run_id bigint, reason string, status string, first_seen_at timestamp_ntz,
last_seen_at timestamp_ntz, occurrence_count bigint, version bigint"""
INCIDENTS = """check_id int, dataset_id bigint, severity string, status string, failure_status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz,
resolved_at timestamp_ntz, current_run_id bigint, occurrence_count bigint, reopen_count bigint"""
VIOLATIONS = "check_id int, fingerprint string, reason string, row string"
#: Statuses whose violating rows are recorded: within its tolerance a check passes, and its rows are acceptable.
RECORDED = ("fail", "warn")


@dataclass(frozen=True)
class Run:
    """What a run leaves behind."""

    results: DataFrame  #: one row per check, with the counts of new, suppressed and regressed exceptions
    violations: DataFrame  #: check_id, fingerprint, reason, row: every violating row of checks that did not pass
    state: DataFrame  #: exceptions after the run, with ``outcome`` and ``auto_resolved``
    events: DataFrame  #: system events of regressions and auto-resolves
    incidents: DataFrame  #: durable incidents after the run, with ``kind`` of the move


def empty_state(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], STATE)


def empty_incidents(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], INCIDENTS)


def _as_violations(rows: DataFrame, columns: Sequence[str], check: Column, why: Column, identity: Sequence[str]) -> DataFrame:
    """Rows as ``check_id``, ``fingerprint``, ``reason``, ``row``; a row is known by its identity columns, if it has them."""
    known = list(identity) if identity and set(identity) <= set(columns) else columns
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return rows.select(check.cast("int").alias("check_id"), row_fingerprint(check, known).alias("fingerprint"), why.alias("reason"), body.alias("row"))


def _shared_violations(df: DataFrame, shared: suite.Shared, identity: Sequence[str]) -> DataFrame | None:
    """The violating rows of all row checks; a row appears once for each check that it violates. None without row checks."""
    found = []
    for spec, _, _ in shared.good:
        by_row = suite.row_predicate(df, spec)
        if by_row is not None:
            found.append(F.when(F.coalesce(by_row[0], F.lit(False)), F.struct(F.lit(spec.check_id).alias("check_id"), reason(spec).alias("reason"))))
    if not found:
        return None
    hits = df.withColumn("_hits", F.array_compact(F.array(*found))).filter(F.size("_hits") > 0)
    return _as_violations(hits.withColumn("_hit", F.explode("_hits")), df.columns, F.col("_hit.check_id"), F.col("_hit.reason"), identity)


def _duplicates(df: DataFrame, spec: CheckSpec, given: DataFrame | None) -> tuple[DataFrame, Column]:
    shown = F.coalesce(F.col(f"`{spec.column}`").cast("string"), F.lit("NULL"))
    return tablechecks.duplicate_rows(df, spec.column), F.concat(F.lit(f"{spec.column} = "), shown, F.lit(" is not unique"))


def _strangers(df: DataFrame, spec: CheckSpec, given: DataFrame | None) -> tuple[DataFrame, Column]:
    shown = F.col(f"`{spec.column}`").cast("string")
    return tablechecks.strangers(df, spec.column, suite.dictionary(df, spec, given), spec.params.get("case_sensitive", True)), F.concat(F.lit(f"{spec.column} = "), shown, F.lit(" not in the accepted set"))


def _contract_breaks(df: DataFrame, spec: CheckSpec, given: DataFrame | None) -> tuple[DataFrame, Column]:
    return suite.contract_breaks(df, spec).filter("violation").drop("violation"), F.concat_ws(" ", "column_name", "change")


def _schema_changes(df: DataFrame, spec: CheckSpec, given: DataFrame | None) -> tuple[DataFrame, Column]:
    if given is None:
        raise ValueError("no baseline was given")
    found = schemachecks.contract_diff(given, schemachecks.column_catalog({"": df}))
    return found.filter("violation").drop("violation"), F.concat_ws(" ", "column_name", "change")


def _strange_rows(df: DataFrame, spec: CheckSpec, given: DataFrame | None) -> tuple[DataFrame, Column]:
    found = outliers.isolation_outliers(df, spec.params.get("keys") or df.columns, spec.params.get("columns"), float(spec.params.get("contamination", 0.005)))
    return found.filter(F.col("status") == "outlier").drop("status"), F.concat(F.lit("isolation score "), F.round("score", 4).cast("string"))


#: How checks that take a pass of their own find their violating rows. Checks of volume, age and distribution have none.
ROWS: dict[str, Callable[[DataFrame, CheckSpec, DataFrame | None], tuple[DataFrame, Column]]] = {
    "unique": _duplicates, "accepted_values": _strangers, "schema_contract": _contract_breaks, "schema_change": _schema_changes, "ml_outlier": _strange_rows,
}


def _own_violations(df: DataFrame, spec: CheckSpec, given: DataFrame | None, identity: Sequence[str]) -> DataFrame | None:
    find, custom = ROWS.get(spec.check_type), CHECK_TYPES[spec.check_type].violations
    if find is not None:
        rows, why = find(df, spec, given)
    elif custom is not None:
        rows, why = custom(df, spec, given), F.lit(f"returned by {spec.name or spec.check_type}")
    else:
        return None
    return _as_violations(rows, rows.columns, F.lit(spec.check_id), why, identity)


def observed_run(df: DataFrame, specs: Sequence[CheckSpec], as_of: datetime | None, identity: Sequence[str] = (), given: Mapping[int, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The results of a suite and the violating rows of its checks that fail or warn, both stored.

    One scan measures all fused checks and writes their violating rows. A check that does not resolve, meets cells that do
    not fit, or fails while it runs becomes an ``error`` row without violations.
    """
    spark = df.sparkSession
    shared, alone = suite.split(df, specs, as_of)
    seen, measures, values = Observation(), shared.measures(), {}
    rows = _shared_violations(df.observe(seen, *measures), shared, identity)
    if rows is None:
        rows = spark.createDataFrame([], VIOLATIONS)
    else:
        rows = stored(rows, "run-violations", "zstd")
        values = seen.get
    if "_rows" not in values:  # nothing is written, or a table without partitions runs no task that could be observed
        values = df.agg(*measures).first().asDict()
    names = sorted(values)
    counts = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
    lines = [r for part in [shared.results(counts)] if part is not None for r in part.collect()]
    parts = [rows]
    for spec in alone:
        baseline = (given or {}).get(spec.check_id)
        line = suite._alone(df, spec, baseline, as_of)
        if line[-2] in RECORDED:
            try:
                own = _own_violations(df, spec, baseline, identity)
                if own is not None:
                    parts.append(stored(own, "run-violations", "zstd"))
            except (PySparkException, Py4JError, ValueError, KeyError, TypeError) as failure:
                line = (*line[:4], None, None, "error", suite._named(failure))
        lines.append(line)
    results = stored(spark.createDataFrame([tuple(r) for r in lines], suite.RESULT), "run-results")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    recorded = [r[0] for r in lines if r[6] in RECORDED]
    return results, every.filter(F.col("check_id").isin(*recorded) if recorded else F.lit(False))


def run_pipeline(
    df: DataFrame, specs: Sequence[CheckSpec], run_id: int, started_at: datetime, state: DataFrame | None = None, open_incidents: DataFrame | None = None,
    identity: Sequence[str] = (), given: Mapping[int, DataFrame] | None = None,
) -> Run:
    """Run a suite and bring exceptions and incidents up to date.

    A check that fails or warns records its violating rows: new ones, ones seen before, and ones that come back after they
    were resolved. A check that passes and did evaluate rows closes its open exceptions. A failing run resolves nothing.
    ``state`` and ``open_incidents`` are those of the run before; a row is known again by ``identity`` (all columns, if
    none are named).
    """
    results, violations = observed_run(df, specs, started_at, identity, given)
    spark = df.sparkSession
    owner = spark.createDataFrame([(s.check_id, s.dataset_id) for s in specs], "check_id int, dataset_id bigint")
    at = F.lit(started_at).cast("timestamp_ntz")
    # Digests cross shuffles and are stored in binary; a sighting takes its place among its copies along, not its row.
    short = violations.select("check_id", packed(F.col("fingerprint")).alias("fingerprint"), "reason", F.xxhash64("row").alias("position"))
    seen = short.join(F.broadcast(owner), "check_id").withColumns({"run_id": F.lit(run_id).cast("bigint"), "seen_at": at})
    before = (state if state is not None else empty_state(df)).withColumn("fingerprint", packed(F.col("fingerprint")))
    after = stored(reconcile.auto_resolve(reconcile.reconcile(before, seen), results), "run-state", "zstd").withColumn("fingerprint", unpacked(F.col("fingerprint")))
    counts = reconcile.reconcile_counts(after)
    finished = results.join(F.broadcast(owner), "check_id").withColumns({"run_id": F.lit(run_id).cast("bigint"), "started_at": at})
    told = results.join(counts, "check_id", "left").na.fill(0, ["new_count", "suppressed_count", "regressed_count"])
    moved = incidents.after_runs(open_incidents if open_incidents is not None else empty_incidents(df), finished)
    events = reconcile.reconcile_events(after).unionByName(reconcile.auto_resolve_events(after))
    return Run(told, violations, after, events, stored(moved, "run-incidents"))

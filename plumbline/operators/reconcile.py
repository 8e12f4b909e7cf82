"""Exception state across runs: reconciliation, auto-resolve and bulk triage.

State has one row per ``(check_id, fingerprint)``. The fingerprint is a digest, so the joins here spread
evenly even where one check or dataset owns most exceptions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import PART, previous_row, spread

KEY = ["check_id", "fingerprint"]
# The comments of system events.
REGRESSED = "regressed: row reappeared after resolve"
PASSING = "auto-resolved: check passing"


def distinct_sightings(sightings: DataFrame) -> DataFrame:
    """One sighting per check and fingerprint: the first by position. Copies combine on the map side."""
    body = F.struct(*[F.col(c) for c in sightings.columns if c not in KEY])
    return sightings.groupBy(*KEY).agg(F.min_by(body, F.col("position")).alias("_s")).select(*KEY, "_s.*")


def _matched(state: DataFrame, sightings: DataFrame) -> DataFrame:
    fresh = distinct_sightings(sightings).select(
        *KEY,
        F.col("dataset_id").alias("s_dataset_id"),
        F.col("run_id").alias("s_run_id"),
        F.col("seen_at").alias("s_seen_at"),
        F.col("reason").alias("s_reason"),
        F.lit(True).alias("_seen"),
    )
    return state.withColumn("_known", F.lit(True)).join(fresh, KEY, "full_outer")


def reconcile(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """Next state after a run that did not pass, with ``outcome`` new, bumped, suppressed, regressed or unseen."""
    m = _matched(state, sightings)
    seen, known = F.col("_seen").isNotNull(), F.col("_known").isNotNull()
    again = seen & known
    regressed = again & (F.col("status") == "resolved")
    outcome = (
        F.when(~seen, "unseen")
        .when(~known, "new")
        .when(F.col("status").isin("expected", "muted"), "suppressed")
        .when(regressed, "regressed")
        .otherwise("bumped")
    )
    newer = lambda fresh, old: F.when(seen, F.col(fresh)).otherwise(F.col(old))
    return m.select(
        *KEY,
        F.coalesce("dataset_id", "s_dataset_id").alias("dataset_id"),
        F.when(known, F.col("run_id")).otherwise(F.col("s_run_id")).alias("run_id"),
        newer("s_run_id", "last_run_id").alias("last_run_id"),
        newer("s_reason", "reason").alias("reason"),
        F.when(~known | regressed, F.lit("open")).otherwise(F.col("status")).alias("status"),
        F.when(known, F.col("first_seen_at")).otherwise(F.col("s_seen_at")).alias("first_seen_at"),
        newer("s_seen_at", "last_seen_at").alias("last_seen_at"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.when(seen, 1).otherwise(0)).cast("bigint").alias("occurrence_count"),
        F.when(~known, F.lit(1)).otherwise(F.coalesce("version", F.lit(1)) + F.when(regressed, 1).otherwise(0)).cast("bigint").alias("version"),
        outcome.alias("outcome"),
    )


def reconcile_events(reconciled: DataFrame) -> DataFrame:
    """System events of a reconciliation: one per regression."""
    return reconciled.filter(F.col("outcome") == "regressed").select(
        *KEY,
        F.lit("system").alias("kind"),
        F.lit("resolved").alias("from_status"),
        F.lit("open").alias("to_status"),
        F.lit(REGRESSED).alias("comment"),
    )


def auto_resolve_events(resolved: DataFrame) -> DataFrame:
    """System events of an auto-resolve: one per record that it closed."""
    return resolved.filter("auto_resolved").select(*KEY, F.lit("system").alias("kind"), F.lit("open").alias("from_status"), F.lit("resolved").alias("to_status"), F.lit(PASSING).alias("comment"))


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    """New, suppressed and regressed records per check, as the run's metrics carry them."""
    kind = F.col("outcome")
    return reconciled.filter(kind != "unseen").groupBy("check_id").agg(
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("new", "suppressed", "regressed")]
    )


def auto_resolve(state: DataFrame, passing_runs: DataFrame) -> DataFrame:
    """Resolve the open exceptions of checks whose run passed and did evaluate rows.

    Passing checks are made distinct first; acknowledged, expected and muted records keep their status.
    """
    passed = passing_runs.filter((F.col("status") == "pass") & F.col("rows_evaluated").isNotNull()).select("check_id").distinct()
    joined = state.join(passed.withColumn("_passed", F.lit(True)), "check_id", "left")
    hit = F.col("_passed").isNotNull() & (F.col("status") == "open")
    return joined.select(
        *[c for c in state.columns if c not in ("status", "version")],
        F.when(hit, "resolved").otherwise(F.col("status")).alias("status"),
        (F.col("version") + F.when(hit, 1).otherwise(0)).cast("bigint").alias("version"),
        hit.alias("auto_resolved"),
    )


@dataclass(frozen=True)
class Triage:
    """One bulk triage request; the ids and expected versions come as a DataFrame."""

    user_id: int
    status: str | None = None
    assign_to: int | None = None
    clear_assignee: bool = False
    note: str | None = None

    def __post_init__(self) -> None:
        if self.status is None and self.assign_to is None and not self.clear_assignee and not self.note:
            raise ValueError("nothing to do: give a status, a note or an assignment")


def triage(state: DataFrame, request: DataFrame, change: Triage, marked_at: Column) -> DataFrame:
    """The state after a triage request of ``(exception_id, expected_version)``.

    The batch applies whole or not at all: one stale or missing version leaves every row as it was. The
    verdict is one boolean from an aggregate, read as a scalar subquery.
    """
    asked = request.select("exception_id", "expected_version").withColumn("_asked", F.lit(True))
    joined = state.join(asked, "exception_id", "left")
    stale = F.col("_asked").isNotNull() & ~F.col("expected_version").eqNullSafe(F.col("version"))
    refused = joined.agg(F.coalesce(F.bool_or(stale), F.lit(False)).alias("refused")).scalar()
    marked = joined.withColumn("refused", refused)
    hit = F.col("_asked").isNotNull() & ~F.col("refused")
    assign = F.when(hit, F.lit(change.assign_to).cast("bigint")).otherwise(F.col("assigned_to_id"))
    restatus = hit & (F.col("status") != F.lit(change.status)) if change.status is not None else F.lit(False)
    touched = restatus | (hit & F.lit(change.assign_to is not None or change.clear_assignee or bool(change.note)))
    return marked.select(
        *[c for c in state.columns if c not in ("status", "version", "assigned_to_id", "marked_at")],
        (F.when(hit, F.lit(change.status)).otherwise(F.col("status")) if change.status is not None else F.col("status")).alias("status"),
        (assign if change.assign_to is not None or change.clear_assignee else F.col("assigned_to_id")).alias("assigned_to_id"),
        F.when(touched, marked_at).otherwise(F.col("marked_at")).alias("marked_at"),
        (F.col("version") + F.when(touched, 1).otherwise(0)).cast("bigint").alias("version"),
        restatus.alias("status_event"),
        (hit & F.lit(change.assign_to is not None or change.clear_assignee)).alias("assign_event"),
        "refused",
    )


def regressions(events: DataFrame, key: str, order: Sequence[str], chunk: Column, bad: Column, fixed: Column) -> DataFrame:
    """Events where something seen as fixed shows up bad again, against the key's event before."""
    marked, chunk = spread(events.withColumn("_fixed", fixed), [key], order, chunk)
    return previous_row(marked, [key], order, ["_fixed"], chunk).filter(F.col("prev__fixed") & bad).drop("_fixed", "prev__fixed", PART)

"""Incidents from run histories: events, durable state, episodes, notifications, routing and escalation.

Only ``fail`` and ``error`` open an incident and only ``pass`` closes it; ``warn`` does neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import SEVERITY_RANK, lookup
from plumbline.operators.joins import last_per_key, salted_join
from plumbline.operators.ordered import PART, carry_forward, previous_row, running_totals, spread
from plumbline.session import stored

FAILURES = ("fail", "error")
ORDER = ["started_at", "run_id"]


def _day() -> Column:
    return F.to_date("started_at")


def _moves(runs: DataFrame) -> tuple[DataFrame, Column]:
    """The moves of :func:`incident_moves`, and chunks for what is computed along them."""
    facts = ["check_id", "dataset_id", "severity", *ORDER, "status"]
    dealt, chunk = spread(runs.select(*facts), ["check_id"], ORDER, _day())
    failing = F.when(F.col("status").isin("pass", *FAILURES), F.col("status").isin(*FAILURES))
    before = {"run_before": F.col("status"), "_was": failing}
    linked = carry_forward(dealt, ["check_id"], ORDER, before, chunk).withColumn("_failing", failing)
    was = F.coalesce(F.col("_was"), F.lit(False))
    kind = F.when(F.col("_failing") & ~was, "opened").when(F.col("_failing"), "occurred").when(~F.col("_failing") & was, "recovered")
    moves = linked.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return moves.select(*facts[:-1], F.col("status").alias("run_status"), "run_before", "kind", *[c for c in dealt.columns if c == PART]), chunk


def incident_moves(runs: DataFrame) -> DataFrame:
    """Runs that open, repeat or close their check's incident: opened, occurred or recovered.

    A fold over ordered runs, written as one carried window, so that a check with a very long history is
    cut into chunks.
    """
    return _moves(runs)[0].drop(PART)


def incident_events(runs: DataFrame) -> DataFrame:
    """The timeline of every check's incident with its episode number and occurrence count."""
    sums = {
        "episode": F.when(F.col("kind") == "opened", 1).otherwise(0),
        "occurrence_count": F.when(F.col("kind") == "recovered", 0).otherwise(1),
    }
    moves, chunk = _moves(runs)
    numbered = running_totals(moves, ["check_id"], ORDER, sums, chunk).drop(PART)
    return numbered.withColumn("reopened", (F.col("kind") == "opened") & (F.col("episode") > 1))


def incident_state(moves: DataFrame) -> DataFrame:
    """One durable incident per check, from aggregates over its moves."""
    at = F.struct(*ORDER)
    failing = F.col("kind") != "recovered"
    last_kind = F.max_by("kind", at)
    return moves.groupBy("check_id").agg(
        F.max("dataset_id").alias("dataset_id"),
        F.max_by("severity", at).alias("severity"),
        F.when(last_kind == "recovered", "resolved").otherwise("open").alias("status"),
        F.max_by(F.when(failing, F.col("run_status")), F.when(failing, at)).alias("failure_status"),
        F.min("started_at").alias("first_seen_at"),
        F.max("started_at").alias("last_seen_at"),
        F.when(last_kind == "recovered", F.max("started_at")).alias("resolved_at"),
        F.max_by("run_id", at).alias("current_run_id"),
        F.count_if(failing).alias("occurrence_count"),
        (F.count_if(F.col("kind") == "opened") - 1).alias("reopen_count"),
    )


def after_runs(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """Durable incidents after one run of each check, with ``kind`` opened, occurred, recovered or null.

    ``runs(check_id, dataset_id, severity, run_id, started_at, status)`` has a row per check; ``incidents`` is what this
    function or :func:`incident_state` returned before. Equal to the state over all moves, without reading them again.
    """
    now = runs.select("check_id", *[F.col(c).alias(f"_{c}") for c in ("dataset_id", "severity", "run_id", "started_at", "status")])
    both = incidents.drop("kind").join(now, "check_id", "full_outer")
    active = F.coalesce(F.col("status").isin("open", "acknowledged"), F.lit(False))
    failing = F.col("_status").isin(*FAILURES)
    kind = F.when(failing & active, "occurred").when(failing, "opened").when((F.col("_status") == "pass") & active, "recovered")
    moved, known = F.col("kind").isNotNull(), F.col("first_seen_at").isNotNull()
    fresh = lambda name, source=None: F.when(moved, F.col(f"_{source or name}")).otherwise(F.col(name)).alias(name)
    out = both.withColumn("kind", kind).filter(known | moved)
    recovered = F.col("kind") == "recovered"
    return out.select(
        "check_id", fresh("dataset_id"), fresh("severity"),
        F.when(recovered, "resolved").when(F.col("kind") == "opened", "open").otherwise(F.col("status")).alias("status"),
        F.when(F.col("kind").isin("opened", "occurred"), F.col("_status")).otherwise(F.col("failure_status")).alias("failure_status"),
        F.coalesce("first_seen_at", "_started_at").alias("first_seen_at"), fresh("last_seen_at", "started_at"),
        F.when(recovered, F.col("_started_at")).when(F.col("kind") == "opened", None).otherwise(F.col("resolved_at")).alias("resolved_at"), fresh("current_run_id", "run_id"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.when(F.col("kind").isin("opened", "occurred"), 1).otherwise(0)).cast("bigint").alias("occurrence_count"),
        (F.coalesce("reopen_count", F.lit(0)) + F.when(known & (F.col("kind") == "opened"), 1).otherwise(0)).cast("bigint").alias("reopen_count"), "kind",
    )


def incident_episodes(events: DataFrame) -> DataFrame:
    """First failure to recovery, one row per episode; an open episode has no recovery."""
    failing = F.col("kind") != "recovered"
    return events.groupBy("check_id", "episode").agg(
        F.min("started_at").alias("opened_at"),
        F.max(F.when(failing, F.col("started_at"))).alias("last_failure_at"),
        F.max(F.when(~failing, F.col("started_at"))).alias("recovered_at"),
        F.count_if(failing).alias("failures"),
    )


def _next_after(candidates: DataFrame) -> DataFrame:
    """For each candidate the first one of its stretch a window or more later: ``check_id, at, run_id, to_at, to_run``.

    An as-of join as one carried value: going back in time, a candidate leaves itself behind, and the question "who is first
    from here on" meets the one left last.
    """
    window = F.greatest(F.lit(1), "dedupe_minutes").cast("bigint") * 60_000_000
    base = ["check_id", "stretch"]
    mine = F.struct("at", "run_id")
    left = candidates.select(*base, (-F.col("at")).alias("back"), F.lit(0).alias("asks"), (-F.col("run_id")).alias("nth"), mine.alias("of"))
    asked = candidates.select(*base, (-F.col("at") - window).alias("back"), F.lit(1).alias("asks"), (-F.col("run_id")).alias("nth"), mine.alias("of"))
    order = ["back", "asks", "nth"]
    points, chunk = spread(left.unionByName(asked), base, order, F.floor(F.col("back") / 86_400_000_000))
    found = carry_forward(points, base, order, {"to": F.when(F.col("asks") == 0, F.col("of"))}, chunk)
    return found.filter((F.col("asks") == 1) & F.col("to").isNotNull()).select("check_id", F.col("of.at").alias("at"), F.col("of.run_id").alias("run_id"), F.col("to.at").alias("to_at"), F.col("to.run_id").alias("to_run"))


def _reached(roots: DataFrame, jumps: DataFrame) -> DataFrame:
    """``check_id, at, run_id`` of all nodes that jumps lead to from ``roots``, themselves included.

    In each round the nodes reached so far take a jump of twice the length of the round before, so a chain of n nodes
    takes log(n) rounds, each an equality join that spreads over all nodes.
    """
    node = ["check_id", "at", "run_id"]
    reached, jumps = stored(roots.select(*node), "reached"), stored(jumps, "jumps")
    while True:
        step = stored(reached.join(jumps, node).select("check_id", F.col("to_at").alias("at"), F.col("to_run").alias("run_id")), "reached")
        if step.isEmpty():
            return reached
        reached = stored(reached.unionByName(step), "reached")
        onward = jumps.select("check_id", F.col("at").alias("to_at"), F.col("run_id").alias("to_run"), F.col("to_at").alias("far_at"), F.col("to_run").alias("far_run"))
        jumps = stored(jumps.join(onward, ["check_id", "to_at", "to_run"]).select(*node, F.col("far_at").alias("to_at"), F.col("far_run").alias("to_run")), "jumps")


def notifications(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Which incident events notify.

    Opening, reopening and recovery always do. A failure that follows a ``warn`` notifies again once the
    check's dedupe window (``windows(check_id, dedupe_minutes)``, 60 where absent) has passed since the
    last notification. That last rule is sequential. A pause of a whole window always re-arms it, so the
    candidates split into independent stretches at such pauses; within a stretch every candidate points to the
    first one a window later, and those that the pointers reach from the stretch's first one notify.
    """
    timed = events.join(windows, "check_id", "left").withColumn("dedupe_minutes", F.coalesce("dedupe_minutes", F.lit(60)))
    candidates = timed.filter((F.col("kind") == "opened") | ((F.col("kind") == "occurred") & (F.col("run_before") == "warn")))
    dealt, chunk = spread(candidates.select("check_id", *ORDER, "kind", "dedupe_minutes"), ["check_id"], ORDER, _day())
    linked = previous_row(dealt, ["check_id"], ORDER, ["started_at"], chunk)
    gap = F.timestamp_diff("MICROSECOND", F.col("prev_started_at"), F.col("started_at"))
    window = F.greatest(F.lit(1), "dedupe_minutes").cast("bigint") * 60_000_000
    fresh = (F.col("kind") == "opened") | F.coalesce(gap >= window, F.lit(True))
    numbered = running_totals(linked.withColumn("fresh", fresh), ["check_id"], ORDER, {"stretch": F.col("fresh").cast("int")}, chunk)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    numbered = numbered.withColumn("at", F.timestamp_diff("MICROSECOND", epoch, F.col("started_at")))
    numbered = stored(numbered.select("check_id", "stretch", "run_id", "started_at", "at", "fresh", "dedupe_minutes"), "candidates")
    told = _reached(numbered.filter("fresh"), _next_after(numbered))
    triggered = numbered.join(told, ["check_id", "at", "run_id"], "left_semi").select("check_id", "run_id", "started_at", F.lit("triggered").alias("action"))
    recovered = events.filter(F.col("kind") == "recovered").select("check_id", "run_id", "started_at", F.lit("recovered").alias("action"))
    return triggered.unionByName(recovered)


def eligible_rules(subjects: DataFrame, rules: DataFrame, spread_by: list[str]) -> DataFrame:
    """Subjects (with dataset_id, severity, run_status) with every enabled rule that covers them.

    The threshold and the optional scope are turned into equality keys: a rule is repeated for each
    severity it accepts, dataset rules join on dataset and severity, global rules on severity with salt.
    """
    rank = lookup(F.col("min_severity"), SEVERITY_RANK, 0)
    levels = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, r in SEVERITY_RANK.items()])
    open_rules = rules.filter("enabled").withColumn("_lvl", F.explode(F.filter(levels, lambda x: x["r"] >= rank)))
    flat = open_rules.select(
        "rule_id", F.col("dataset_id").alias("_scope"), "channel", "on_error_runs", "dedupe_window_minutes",
        "escalation_delay_minutes", "max_escalation_level", F.col("_lvl.s").alias("_severity"),
    )
    keyed = subjects.withColumn("_severity", F.when(F.col("severity").isin(*SEVERITY_RANK), F.col("severity")).otherwise("info"))
    scoped = keyed.withColumn("_scope", F.col("dataset_id")).join(flat.filter(F.col("_scope").isNotNull()), ["_scope", "_severity"])
    everywhere = salted_join(keyed, flat.filter(F.col("_scope").isNull()).drop("_scope"), ["_severity"], spread_by)
    both = scoped.drop("_scope").unionByName(everywhere).drop("_severity")
    return both.filter((F.col("run_status") != "error") | F.col("on_error_runs"))


def dedupe_windows(routed: DataFrame) -> DataFrame:
    """The shortest dedupe window per check among its rules; an unset window is an hour."""
    minutes = F.coalesce(F.nullif(F.col("dedupe_window_minutes"), F.lit(0)), F.lit(60))
    return routed.groupBy("check_id").agg(F.min(minutes).alias("dedupe_minutes"))


def next_escalations(incidents: DataFrame, routed: DataFrame, base: str) -> DataFrame:
    """When each active incident escalates next, how far it may go, and the delay of the step after that."""
    level, delay = F.coalesce("max_escalation_level", F.lit(0)), F.coalesce("escalation_delay_minutes", F.lit(0))
    wait = lambda above: F.min(F.when((level > above) & (delay > 0), F.greatest(F.lit(1), delay)))
    now, then = wait(F.col("escalation_level")), wait(F.col("escalation_level") + 1)
    limits = routed.groupBy("check_id").agg(F.max(level).alias("max_level"), now.alias("_delay"), then.alias("delay_after"))
    joined = incidents.join(limits, "check_id")
    return joined.withColumn(
        "next_escalation_at", F.col(base) + F.make_dt_interval(mins=F.col("_delay"))
    ).drop("_delay")


def escalations_due(incidents: DataFrame, now: Column) -> DataFrame:
    """Active incidents whose next escalation is due and whose level may still rise, escalated.

    ``due_at`` is when they were due; ``next_escalation_at`` is the time of the step after, null after the last.
    """
    due = F.col("status").isin("open", "acknowledged") & (F.col("next_escalation_at") <= now)
    risen = incidents.filter(due & (F.col("max_level") > F.col("escalation_level")))
    after = now + F.make_dt_interval(mins=F.col("delay_after"))
    return risen.withColumns({"due_at": F.col("next_escalation_at"), "next_escalation_at": after, "escalation_level": F.col("escalation_level") + 1}).drop("delay_after")


def apply_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Incidents after what users did: ``actions(check_id, action, at)`` with ``acknowledge`` and ``resolve``.

    The last action of a check counts. Only an open incident is acknowledged; an open or acknowledged one is resolved, at
    the time of the action. ``acted`` says whether the action changed the incident.
    """
    last = last_per_key(actions.select("check_id", "action", F.col("at").alias("_at")), ["check_id"], ["_at", "action"])
    joined = incidents.join(last, "check_id", "left")
    noted = F.coalesce((F.col("action") == "acknowledge") & (F.col("status") == "open"), F.lit(False))
    closed = F.coalesce((F.col("action") == "resolve") & F.col("status").isin("open", "acknowledged"), F.lit(False))
    return joined.select(
        *[c for c in incidents.columns if c not in ("status", "resolved_at")],
        F.when(closed, "resolved").when(noted, "acknowledged").otherwise(F.col("status")).alias("status"),
        F.when(closed, F.col("_at")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        (noted | closed).alias("acted"),
    )


def retire(incidents: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Resolve active incidents of checks that no longer run."""
    gone = checks.filter(F.col("status").isin("archived", "disabled")).select("check_id").distinct().withColumn("_gone", F.lit(True))
    joined = incidents.join(gone, "check_id", "left")
    hit = F.col("_gone").isNotNull() & (F.col("status") != "resolved")
    return joined.select(
        *[c for c in incidents.columns if c not in ("status", "resolved_at")],
        F.when(hit, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(hit, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
        hit.alias("retired"),
    )

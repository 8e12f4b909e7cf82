"""State across runs: carried windows, exceptions, incidents, scores, service levels and graphs."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.operators import exceptions, incidents, insights, joins, lineage, ordered, reconcile, scorecards, sla
from plumbline.plans import triage_queries
from plumbline.plans.feeds import Data, moment
from plumbline.session import run_folder, stored
from plumbline.streaming import incidents as stream_incidents
from plumbline.streaming import monitors

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark: SparkSession) -> DataFrame:
    """Key 0 holds two thirds of all rows; some values are NULL."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.66 else rng.randint(1, 20), i, None if rng.random() < 0.2 else rng.randint(0, 9)) for i in range(4000)]
    return spark.createDataFrame(rows, "k int, t int, v int").cache()


def _chunk() -> Column:
    return F.floor(F.col("t") / 100)


def _plain() -> WindowSpec:
    return Window.partitionBy("k").orderBy("t")


def _same(a: DataFrame, b: DataFrame) -> bool:
    cols = sorted(a.columns)
    return sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def test_previous_row_equals_lag(hot: DataFrame) -> None:
    assert _same(ordered.previous_row(hot, ["k"], ["t"], ["v"], _chunk()), hot.withColumn("prev_v", F.lag("v").over(_plain())))


def test_carry_forward_equals_last_value(hot: DataFrame) -> None:
    plain = hot.withColumn("seen", F.last("v", ignorenulls=True).over(_plain().rowsBetween(Window.unboundedPreceding, -1)))
    assert _same(ordered.carry_forward(hot, ["k"], ["t"], {"seen": F.col("v")}, _chunk()), plain)


def test_running_totals_equal_running_sum(hot: DataFrame) -> None:
    value = F.coalesce("v", F.lit(0))
    plain = hot.withColumn("total", F.sum(value).over(_plain().rowsBetween(Window.unboundedPreceding, 0)))
    assert _same(ordered.running_totals(hot, ["k"], ["t"], {"total": value}, _chunk()), plain)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_lookback_equals_frame(hot: DataFrame, block: int) -> None:
    made = ordered.lookback(hot, ["k"], ["t"], 7, {"past": lambda w: F.collect_list("v").over(w)}, _chunk(), block)
    assert _same(made, hot.withColumn("past", F.collect_list("v").over(_plain().rowsBetween(-7, -1))))


def test_salted_join_equals_join(hot: DataFrame, spark: SparkSession) -> None:
    few = spark.createDataFrame([(v, f"n{v % 3}") for v in range(10)], "v int, name string")
    assert _same(joins.salted_join(hot, few, ["v"], ["t"]), hot.join(few, "v"))


STATE = "check_id int, fingerprint string, dataset_id int, run_id int, last_run_id int, reason string, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, occurrence_count int, version int"
SIGHT = "check_id int, fingerprint string, dataset_id int, run_id int, seen_at timestamp_ntz, reason string, position int"


def test_exception_life_cycle(spark: SparkSession) -> None:
    old = [(1, f"f-{s}", 1, 10, 10, "old", s, START, START, 2, 1) for s in ("open", "acknowledged", "expected", "muted", "resolved", "gone")]
    later = START + timedelta(days=1)
    seen = [(1, f"f-{s}", 1, 11, later, "new", i) for i, s in enumerate(("open", "open", "acknowledged", "expected", "muted", "resolved", "first"))]
    after = reconcile.reconcile(spark.createDataFrame(old, STATE), spark.createDataFrame(seen, SIGHT))
    rows = {r["fingerprint"]: r for r in after.collect()}
    assert {f: r["outcome"] for f, r in rows.items()} == {
        "f-open": "bumped", "f-acknowledged": "bumped", "f-expected": "suppressed", "f-muted": "suppressed", "f-resolved": "regressed", "f-gone": "unseen", "f-first": "new",
    }
    assert rows["f-open"]["occurrence_count"] == 3 and rows["f-open"]["version"] == 1
    assert (rows["f-resolved"]["status"], rows["f-resolved"]["version"]) == ("open", 2)
    assert (rows["f-expected"]["status"], rows["f-gone"]["occurrence_count"], rows["f-first"]["version"]) == ("expected", 2, 1)
    assert reconcile.reconcile_events(after).count() == 1
    counts = reconcile.reconcile_counts(after).first()
    assert (counts["new_count"], counts["suppressed_count"], counts["regressed_count"]) == (1, 2, 1)
    runs = spark.createDataFrame([(1, "pass", 100)], "check_id int, status string, rows_evaluated bigint")
    resolved = reconcile.auto_resolve(after, runs)
    assert {r["fingerprint"] for r in resolved.filter("auto_resolved").collect()} == {"f-open", "f-resolved", "f-first"}
    assert reconcile.auto_resolve(after, runs.withColumn("rows_evaluated", F.lit(None).cast("bigint"))).filter("auto_resolved").count() == 0


def test_triage_is_all_or_nothing(spark: SparkSession) -> None:
    state = spark.createDataFrame([(1, "open", None, None, 1), (2, "open", None, None, 4)], "exception_id int, status string, assigned_to_id bigint, marked_at timestamp_ntz, version int")
    change = reconcile.Triage(1, status="resolved")
    for versions, applied in (([1, 4], 2), ([1, 3], 0), ([1, None], 0)):
        request = spark.createDataFrame(list(zip([1, 2], versions, strict=True)), "exception_id int, expected_version int")
        out = reconcile.triage(state, request, change, moment(START))
        assert out.filter("status = 'resolved' AND version > 1 AND marked_at IS NOT NULL").count() == applied
    with pytest.raises(ValueError):
        reconcile.Triage(1)


def _history(spark: SparkSession, checks: int = 6, n: int = 120) -> tuple[DataFrame, list[tuple]]:
    rng = random.Random(11)
    rows, run_id = [], 0
    for c in range(checks):
        at = START
        for _ in range(n):
            run_id += 1
            at += timedelta(minutes=rng.choice([5, 20, 45, 90]))
            rows.append((c, 1, "error", run_id, at, rng.choice(["pass", "warn", "warn", "fail", "fail", "error"])))
    return spark.createDataFrame(rows, "check_id bigint, dataset_id bigint, severity string, run_id bigint, started_at timestamp_ntz, status string").cache(), rows


def _folded(rows: list[tuple], window: int) -> tuple[list[tuple], set[tuple]]:
    """The life cycle, run by run."""
    events, notified = [], set()
    state: dict[int, dict] = {}
    for c, _, _, run, at, status in sorted(rows, key=lambda r: (r[0], r[4], r[3])):
        s = state.setdefault(c, {"failing": False, "episode": 0, "n": 0, "last": None, "before": None})
        if status in ("fail", "error"):
            s["n"] += 1
            if not s["failing"]:
                s["failing"], s["episode"], s["last"] = True, s["episode"] + 1, at
                events.append((c, run, "opened", s["episode"], s["n"]))
                notified.add((c, run, "triggered"))
            else:
                events.append((c, run, "occurred", s["episode"], s["n"]))
                if s["before"] == "warn" and at - s["last"] >= timedelta(minutes=window):
                    s["last"] = at
                    notified.add((c, run, "triggered"))
        elif status == "pass" and s["failing"]:
            s["failing"] = False
            events.append((c, run, "recovered", s["episode"], s["n"]))
            notified.add((c, run, "recovered"))
        s["before"] = status
    return events, notified


def test_incidents_equal_the_fold(spark: SparkSession) -> None:
    runs, rows = _history(spark)
    events, notified = _folded(rows, 60)
    timeline = incidents.incident_events(runs).cache()
    made = [(r["check_id"], r["run_id"], r["kind"], r["episode"], r["occurrence_count"]) for r in timeline.collect()]
    assert sorted(made) == sorted(events)
    windows = spark.createDataFrame([(c, 60) for c in range(3)], "check_id bigint, dedupe_minutes int")
    sent = incidents.notifications(timeline, windows).collect()
    assert {(r["check_id"], r["run_id"], r["action"]) for r in sent} == notified and len(sent) == len(notified)
    state = {r["check_id"]: r for r in incidents.incident_state(incidents.incident_moves(runs)).collect()}
    for c in range(6):
        mine = [e for e in events if e[0] == c]
        assert state[c]["occurrence_count"] == mine[-1][4]
        assert state[c]["status"] == ("resolved" if mine[-1][2] == "recovered" else "open")
        assert state[c]["reopen_count"] == mine[-1][3] - 1


def test_shuffled_runs_over_many_batches_equal_the_batch(spark: SparkSession) -> None:
    """Each micro-batch holds runs of all times within the delay; a last run of another check moves the watermark on."""
    runs, rows = _history(spark, checks=3, n=40)
    home = run_folder(spark, "stream-test")
    rng = random.Random(9)
    shuffled = sorted(rows, key=lambda r: r[4] + timedelta(hours=rng.uniform(0, 6)))
    shuffled.append((99, *shuffled[0][1:4], max(r[4] for r in rows) + timedelta(days=2), "warn"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_incidents.ROCKSDB)
    for k in range(0, len(shuffled), 25):
        spark.createDataFrame(shuffled[k : k + 25], runs.schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(runs.schema).parquet(f"{home}/in")
        made = stream_incidents.incident_stream(stream, "7 hours")
        made.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(availableNow=True).start().awaitTermination()
    got = [(r["check_id"], r["run_id"], r["kind"], r["episode"], r["occurrence_count"]) for r in spark.read.parquet(f"{home}/out").collect()]
    assert sorted(got) == sorted(_folded(rows, 60)[0])


def test_incident_stream_equals_batch_over_several_batches(spark: SparkSession) -> None:
    runs, rows = _history(spark, checks=3, n=40)
    home = run_folder(spark, "stream-test")
    cut = START + timedelta(hours=12)
    end = spark.createDataFrame([(99, *rows[0][1:4], max(r[4] for r in rows) + timedelta(days=2), "warn")], runs.schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_incidents.ROCKSDB)
    for part in (runs.filter(F.col("started_at") < moment(cut)), runs.filter(F.col("started_at") >= moment(cut)).unionByName(end)):
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(runs.schema).parquet(f"{home}/in")
        query = (
            stream_incidents.incident_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    made = [(r["check_id"], r["run_id"], r["kind"], r["episode"], r["occurrence_count"]) for r in spark.read.parquet(f"{home}/out").collect()]
    assert sorted(made) == sorted(_folded(rows, 60)[0])


def test_first_sightings_are_unique(spark: SparkSession) -> None:
    home = run_folder(spark, "dedup-test")
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit(START).cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(f"{home}/events.parquet")
    stream = monitors.timed(spark.readStream.schema(rows.schema).parquet(f"{home}/events.parquet"), "ts", "1 day")
    assert monitors.drain(monitors.first_sightings(stream, F.col("k").cast("string")), "dedup-out").count() == 7


def _score(spark: SparkSession, checks: list[tuple], statuses: list[tuple], importance: str = "medium", opened: int = 0) -> dict:
    datasets = spark.createDataFrame([(1, "orders", "", "", "", importance, None, True)], "dataset_id int, table_name string, domain string, team string, owner string, importance string, slo_target_score double, slo_enabled boolean")
    made = scorecards.dataset_scores(
        datasets,
        spark.createDataFrame(checks, "check_id int, dataset_id int, severity string, status string"),
        spark.createDataFrame(statuses, "check_id int, status string"),
        spark.createDataFrame([(1, opened)], "dataset_id int, open_exceptions bigint"),
    )
    return made.first().asDict()


def test_scores(spark: SparkSession) -> None:
    three = [(1, 1, "info", "active"), (2, 1, "warn", "active"), (3, 1, "error", "active")]
    s = _score(spark, three, [(1, "pass"), (2, "warn"), (3, "fail")])
    assert (s["score"], s["slo_target"], s["slo_status"]) == (34.29, 90.0, "breached")
    one = [(1, 1, "error", "active")]
    s = _score(spark, one, [(9, "pass")], "low")
    assert (s["score"], s["unknown_checks"], s["slo_target"]) == (50.0, 1, 85.0)
    s = _score(spark, [(1, 1, "error", "disabled")], [(1, "pass")], "critical")
    assert (s["score"], s["slo_target"], s["slo_status"], s["active_checks"]) == (None, 98.0, "unknown", 0)
    s = _score(spark, one, [(1, "pass")], "low", opened=100)
    assert (s["base_score"], s["exception_penalty"], s["score"]) == (100.0, 30.0, 70.0)


def test_rollup_weighs_by_importance(spark: SparkSession) -> None:
    datasets = spark.createDataFrame(
        [(1, "orders", "", "", "", "critical", None, True), (2, "events", "Marketing", "Growth", "", "low", None, True)],
        "dataset_id int, table_name string, domain string, team string, owner string, importance string, slo_target_score double, slo_enabled boolean",
    )
    checks = spark.createDataFrame([(1, 1, "error", "active"), (2, 2, "error", "active")], "check_id int, dataset_id int, severity string, status string")
    statuses = spark.createDataFrame([(1, "pass"), (2, "fail")], "check_id int, status string")
    rows = {(r["grain"], r["key"]): r for r in scorecards.rollups(scorecards.dataset_scores(datasets, checks, statuses)).collect()}
    assert rows[("global", "")]["score"] == 80.0
    assert (rows[("domain", "")]["label"], rows[("domain", "")]["total_datasets"]) == ("Unassigned", 1)


def test_service_levels(spark: SparkSession) -> None:
    slas = spark.createDataFrame(
        [(1, "check", 1, "check_success", 0.9, 7), (2, "check", 2, "check_success", 1.0, 30), (3, "check", 3, "check_success", 0.99, 30)],
        "sla_id int, scope string, scope_id int, target_type string, objective double, window_days int",
    )
    checks = spark.createDataFrame([(c, 1, "range") for c in (1, 2, 3)], "check_id int, dataset_id int, check_type string")
    runs = spark.createDataFrame(
        [(1, START + timedelta(days=25 + i), s) for i, s in enumerate(["warn", "pass", "fail", "pass"])] + [(2, START + timedelta(days=9), "error")],
        "check_id int, started_at timestamp_ntz, status string",
    )
    none = spark.createDataFrame([], "check_id int, status string, first_seen_at timestamp_ntz, marked_at timestamp_ntz")
    rows = {r["sla_id"]: r for r in sla.evaluate(slas, checks, runs, none, START + timedelta(days=30)).collect()}
    assert (rows[1]["attainment"], rows[1]["budget_consumed"], rows[1]["breached"]) == (0.75, 2.0, True)
    assert (rows[2]["attainment"], rows[2]["budget_consumed"]) == (0.0, 1.0)
    assert (rows[3]["attainment"], rows[3]["budget_consumed"], rows[3]["breached"]) == (1.0, 0.0, False)


def test_walks(spark: SparkSession) -> None:
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "a"), ("y", "z")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in lineage.downstream(edges, start).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["id"] for r in lineage.upstream(edges, start).collect()} == {"a", "x"}
    nodes, kept = lineage.subgraph(edges, start, 1)
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "x"} and kept.count() == 2


def test_names_resolve(spark: SparkSession) -> None:
    catalog = spark.createDataFrame([("s", "Orders", "s.orders"), ("s", "Dup", "s.dup"), ("t", "dup", "t.dup")], "schema_name string, table_name string, node_id string")
    refs = spark.createDataFrame([("S", "orders"), (None, "orders"), ("q", "dup"), (None, "dup")], "ref_schema string, ref_name string")
    made = {(r["ref_schema"], r["ref_name"]): (r["node_id"], r["resolved_by"]) for r in lineage.resolve_references(refs, catalog).collect()}
    assert made == {
        ("S", "orders"): ("s.orders", "exact"), (None, "orders"): ("s.orders", "unique_name"), ("q", "dup"): ("q.dup", "external"), (None, "dup"): ("dup", "external"),
    }


def test_status_as_of_days(spark: SparkSession) -> None:
    runs = spark.createDataFrame([(1, START, 1, "fail"), (1, START + timedelta(hours=3), 2, "pass"), (1, START + timedelta(days=3), 3, "warn")], "check_id int, started_at timestamp_ntz, run_id int, status string")
    made = {r["day"]: r["status"] for r in joins.status_as_of_days(runs, ["check_id"], F.lit(date(2024, 1, 5))).collect()}
    assert made == {date(2024, 1, d): s for d, s in ((1, "pass"), (2, "pass"), (3, "pass"), (4, "warn"), (5, "warn"))}


def test_visibility(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, 1), (2, 2)], "dataset_id int, connection_id int")
    grants = spark.createDataFrame([(7, 1)], "user_id int, connection_id int")
    assert insights.visible(rows, grants, 7, "editor").count() == 1
    assert insights.visible(rows, grants, 8, "viewer").count() == 2
    assert insights.visible(rows, grants, 7, "admin").count() == 2


def test_stored_tables_live_in_the_shared_folder(spark: SparkSession) -> None:
    kept = stored(spark.range(5).toDF("id"), "t")
    assert kept.count() == 5 and spark.conf.get("spark.checkpoint.dir") in kept.inputFiles()[0]


@pytest.fixture
def one_hot_day(spark: SparkSession) -> DataFrame:
    """One check with all its runs in one day, many of them at the same time, and a few others."""
    rng = random.Random(11)
    rows = [(1 if i % 20 else i, 1, "error", i, datetime(2024, 3, 1) + timedelta(seconds=i // 3), rng.choice(["fail", "warn", "pass", "fail"])) for i in range(9000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "check_id long, dataset_id long, severity string, run_id long, started_at timestamp_ntz, status string").repartition(3).cache()


def test_a_hot_key_in_one_day_is_spread(spark: SparkSession, one_hot_day: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    plain = sorted(map(str, incidents.incident_events(one_hot_day).collect()))
    monkeypatch.setattr(ordered, "CROWD", 500)
    dealt, chunk = ordered.spread(one_hot_day, ["check_id"], incidents.ORDER, F.to_date("started_at"))
    sizes = [r["count"] for r in dealt.filter("check_id = 1").groupBy(chunk).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * 500 and dealt.count() == one_hot_day.count()
    assert sorted(map(str, incidents.incident_events(one_hot_day).collect())) == plain
    total = ordered.running_totals(dealt, ["check_id"], incidents.ORDER, {"n": F.lit(1)}, chunk).filter("check_id = 1")
    last = total.orderBy("started_at", "run_id").collect()
    assert [r["n"] for r in last] == list(range(1, len(last) + 1))
    # Rows that only differ in the second column of the order are told apart too.
    same_time = one_hot_day.withColumn("started_at", F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz"))
    dealt, chunk = ordered.spread(same_time, ["check_id"], incidents.ORDER, F.to_date("started_at"))
    assert dealt.filter("check_id = 1").select(chunk).distinct().count() > 8


def test_notifications_of_a_flapping_check(spark: SparkSession, one_hot_day: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    """Against a walk over the candidates; no task of the plan runs Python."""
    timeline = incidents.incident_events(one_hot_day.filter("status <> 'pass' or run_id % 5 = 0")).cache()
    windows = spark.createDataFrame([(1, 3), (20, 0)], "check_id long, dedupe_minutes int")
    want, last = set(), {}
    minutes = {1: 3, 20: 0}
    for r in timeline.orderBy("check_id", "started_at", "run_id").collect():
        if r["kind"] == "recovered":
            want.add((r["check_id"], r["run_id"], "recovered"))
        elif r["kind"] == "opened" or r["run_before"] == "warn":
            window = timedelta(minutes=max(1, minutes.get(r["check_id"], 60)))
            if r["kind"] == "opened" or r["check_id"] not in last or r["started_at"] - last[r["check_id"]] >= window:
                last[r["check_id"]] = r["started_at"]
                want.add((r["check_id"], r["run_id"], "triggered"))
    for crowd in (10**6, 400):
        monkeypatch.setattr(ordered, "CROWD", crowd)
        sent = incidents.notifications(timeline, windows)
        got = [(r["check_id"], r["run_id"], r["action"]) for r in sent.collect()]
        assert set(got) == want and len(got) == len(want)
    assert "Python" not in sent._jdf.queryExecution().executedPlan().toString()


def test_pages_by_position_equal_pages_by_offset(spark: SparkSession) -> None:
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 2, None, 7]), rng.choice(["error", "warn", "info", None])) for i in range(200)]
    listed = spark.createDataFrame(rows, "exception_id long, occurrence_count long, severity string")
    for sort in exceptions.SORTS:
        after, seen = None, []
        while page := exceptions.seek(listed, sort, after, 30).collect():
            seen += [r["exception_id"] for r in page]
            after = page[-1]["position"]
        assert seen == [r["exception_id"] for r in exceptions.page(listed.na.fill(0, ["occurrence_count"]), sort, 0, 500).collect()]


def test_filters_by_name(spark: SparkSession) -> None:
    row = (1, 5, 7, "open", 2, START, START, "Late Row", None, "check a", "range", "error", 3)
    names = "exception_id long, dataset_id long, check_id long, status string, occurrence_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, reason string, note string, check_name string, check_type string, severity string, assigned_to_id long"
    listed = spark.createDataFrame([row], names)
    hit = lambda **f: exceptions.filter_exceptions(listed, as_of=START + timedelta(hours=5), **f).count()
    assert all(hit(**f) for f in ({}, {"dataset_id": 5}, {"status": ["open"]}, {"assignee": "3"}, {"recurrence": "new"}, {"recurrence": "recurring"}, {"text": "LATE"}, {"status": [], "text": ""}, {"assignee": "me", "user_id": 3}))
    assert not any(hit(**f) for f in ({"check_id": 8}, {"severity": ["warn"]}, {"assignee": "none"}, {"seen_since": START + timedelta(days=1)}, {"assignee": "me", "user_id": 4}))
    scope = spark.createDataFrame([(5,), (5,)], "dataset_id long")
    assert exceptions.filter_exceptions(listed, scope, as_of=START).count() == 1 and exceptions.filter_exceptions(listed, scope.filter("dataset_id = 6"), as_of=START).count() == 0
    with pytest.raises(KeyError):
        hit(colour="red")


class _Held:
    """The state of one check in memory, as the state API gives it, with the number of calls."""

    def __init__(self) -> None:
        self.value, self.places, self.calls, self.timers, self.now = None, {}, 0, [], 0

    def getValueState(self, name: str, schema: str) -> _Held:  # noqa: N802
        return self

    def getMapState(self, name: str, key: str, value: str) -> _Held:  # noqa: N802
        return self

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self) -> int:  # noqa: N802
        return self.now

    def exists(self) -> bool:
        self.calls += 1
        return self.value is not None

    def get(self) -> tuple | None:
        self.calls += 1
        return self.value

    def update(self, value: tuple) -> None:
        self.calls, self.value = self.calls + 1, value

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        self.calls += 1
        return key in self.places

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        self.calls += 1
        return self.places.get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.calls, self.places[key] = self.calls + 1, value

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.calls += 1
        del self.places[key]

    def keys(self) -> list[tuple]:
        self.calls += 1
        return list(self.places)


def _released(times: list[int], cuts: list[int], batch: int) -> tuple[list[tuple], _Held]:
    """Run and kind of the incident events of runs at these microseconds that fail in every third, over batches and watermarks."""
    held, made = _Held(), []
    processor = stream_incidents.IncidentProcessor()
    processor.init(held)
    rows = [(t, i, "fail" if i % 3 == 0 else "warn" if i % 3 == 1 else "pass") for i, t in enumerate(times)]
    random.Random(5).shuffle(rows)
    for k in range(0, len(rows), batch):
        assert not list(processor.handleInputRows((1,), iter([pd.DataFrame(rows[k : k + batch], columns=["at", "run_id", "status"])]), held))
    for cut in cuts:
        held.now = cut // 1000
        made += [(r.run_id, r.kind) for part in processor.handleExpiredTimer((1,), held, None) for r in part.itertuples()]
    return made, held


def test_a_check_that_runs_every_few_hours_waits_in_few_places() -> None:
    times = [i * 8 * stream_incidents.HOUR for i in range(90)]
    made, held = _released(times, [times[-1]], 90)
    assert made == [(i, "opened" if i % 3 == 0 else "recovered") for i in range(90) if i % 3 != 1]
    assert not held.places and held.calls <= 20


def test_a_check_with_many_runs_waits_by_hour_and_leaves_nothing() -> None:
    n = stream_incidents.BLOCK * 2
    times = [(i - n // 2) * 60_000_000 for i in range(n)]  # one a minute, from before 1970 on
    made, held = _released(times, [times[0], times[n // 3], times[n // 2], times[-1]], 3_000)
    assert made == [(i, "opened" if i % 3 == 0 else "recovered") for i in range(n) if i % 3 != 1]
    assert not held.places


def test_edges_are_made_distinct_by_as_many_tasks_as_the_rows_need(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """Keys repeat and are null; no task holds more than a fixed number of rows."""
    rng = random.Random(4)
    some = lambda n: None if rng.random() < 0.1 else rng.randint(1, n)
    lines = [(some(9), some(9), some(9)) for _ in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(s, s % 3) for s in range(1, 9)] + [(3, 0), (4, 2), (None, 1), (5, None)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    nations = [(0, 1), (1, 1), (2, None), (2, 2), (None, 1)]
    spark.createDataFrame(nations, "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    want = set()
    for _, p, s in lines:
        for n in [n for k, n in suppliers if k == s is not None]:
            for r in [r for k, r in nations if k == n is not None]:
                want.add((p and f"supplier_{s}.part_{p}", p and f"nation_{n}.part_{p}"))
                want.add((p and f"nation_{n}.part_{p}", p and r and f"region_{r}.part_{p}"))
    monkeypatch.setattr(joins, "DISTINCT_ROWS", 50)
    made = triage_queries.column_edges(Data(spark, str(tmp_path)))
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert made.rdd.getNumPartitions() == 2 * 600 // 50

"""A run from end to end: observed measures, recorded rows, exceptions and incidents."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fingerprint
from plumbline.operators import contracts, drift, incidents, profile, propose, runs, suite
from plumbline.operators.spec import CheckSpec

AT = datetime(2024, 5, 1)
SPECS = [
    CheckSpec(1, "not_null", "name"),
    CheckSpec(2, "range", "age", {"max": 90}, dataset_id=7),
    CheckSpec(3, "range", "code", {"min": 0}),  # text: cells that are no numbers make it an error
    CheckSpec(4, "unique", "name"),
    CheckSpec(5, "custom_sql", params={"sql": "SELECT id FROM source WHERE age > 95"}),
    CheckSpec(6, "custom_sql", params={"sql": "SELECT id FROM source WHERE 1 / (id - id) > 0"}),
    CheckSpec(7, "row_count_min", params={"min_rows": 50}),
    CheckSpec(8, "schema_contract", params={"expected_columns": [("id", None, None), ("lost", "string", None)]}),
    CheckSpec(9, "range", "age", {"max": 98}, tolerance=5),
]


@pytest.fixture
def people(spark: SparkSession, tmp_path) -> DataFrame:  # noqa: ANN001
    rows = [(i, None if i < 3 else f"n{i // 2}", i, "x" if i == 9 else str(i), "_") for i in range(100)]
    spark.createDataFrame(rows, "id long, name string, age int, code string, _hidden string").write.parquet(f"{tmp_path}/people")
    return spark.read.parquet(f"{tmp_path}/people")


def test_one_scan_measures_and_writes(people: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    written: list[DataFrame] = []
    keep = runs.stored
    monkeypatch.setattr(runs, "stored", lambda df, purpose: written.append(df) or keep(df, purpose))
    results, violations = runs.observed_run(people, SPECS[:3], AT, ["id"])
    assert sorted(map(str, results.collect())) == sorted(map(str, suite.run_suite(people, SPECS[:3], AT).collect()))
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    assert {(r["check_id"], r["reason"]) for r in violations.collect()} >= {(1, "name is NULL"), (2, "age = 95 outside [-inf, 90]")}
    assert '"_hidden":"_"' in violations.first()["row"]


def test_every_kind_of_check_records_its_rows(people: DataFrame) -> None:
    results, violations = runs.observed_run(people, SPECS, AT, ["id"])
    assert sorted(map(str, results.collect())) == sorted(map(str, suite.run_suite(people, SPECS, AT).collect()))
    found = {r["check_id"]: r["n"] for r in violations.groupBy("check_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Check 3 met cells that do not fit, 6 failed, 7 has no rows to blame, 9 is within its tolerance.
    assert found == {1: 3, 2: 9, 4: 96, 5: 4, 8: 1}
    same = violations.filter("check_id in (2, 5)").groupBy("check_id").agg(F.collect_set("fingerprint").alias("f")).collect()
    assert all(len(r["f"]) == found[r["check_id"]] for r in same)


def test_a_table_without_rows(spark: SparkSession) -> None:
    nothing = spark.createDataFrame([], "id long, name string, age int, code string")
    results, violations = runs.observed_run(nothing, SPECS[:3] + SPECS[6:7], AT)
    assert {r["check_id"]: r["status"] for r in results.collect()} == {1: "pass", 2: "pass", 3: "pass", 7: "fail"}
    assert violations.count() == 0


def test_life_of_an_exception(people: DataFrame) -> None:
    """Recorded, seen again, resolved by an analyst, back, and closed once the check passes."""
    check = [CheckSpec(2, "range", "age", {"max": 95}, dataset_id=7)]
    at = lambda n: AT + timedelta(days=n)
    one = runs.run_pipeline(people, check, 1, at(0), identity=["id"])
    assert [tuple(r) for r in one.state.select("outcome", "status", "dataset_id", "occurrence_count").distinct().collect()] == [("new", "open", 7, 1)]
    assert one.results.first()["new_count"] == 4 and one.incidents.first()["kind"] == "opened"
    marked = one.state.withColumn("status", F.when(F.col("reason") == "age = 96 outside [-inf, 95]", "resolved").when(F.col("reason").contains("97"), "muted").otherwise(F.col("status")))
    two = runs.run_pipeline(people, check, 2, at(1), marked, one.incidents, ["id"])
    assert {r["outcome"]: (r["status"], r["version"]) for r in two.state.collect()} == {"regressed": ("open", 2), "suppressed": ("muted", 1), "bumped": ("open", 1)}
    assert two.events.count() == 1 and two.incidents.first()["kind"] == "occurred"
    three = runs.run_pipeline(people.filter("age < 90"), check, 3, at(2), two.state, two.incidents, ["id"])
    assert sorted(r["status"] for r in three.state.collect()) == ["muted", "resolved", "resolved", "resolved"]
    assert {r["comment"] for r in three.events.collect()} == {"auto-resolved: check passing"} and three.events.count() == 3
    ended = three.incidents.first()
    assert (ended["status"], ended["resolved_at"], ended["kind"], ended["occurrence_count"]) == ("resolved", at(2), "recovered", 2)
    four = runs.run_pipeline(people, check, 4, at(3), three.state, three.incidents, ["id"])
    again = four.incidents.first()
    assert (again["status"], again["resolved_at"], again["reopen_count"], again["first_seen_at"]) == ("open", None, 1, at(0))
    assert four.state.filter("outcome = 'regressed'").count() == 3


def test_incidents_run_by_run_equal_all_at_once(spark: SparkSession) -> None:
    rng = random.Random(3)
    history = [(c, c % 3, "error", n * 10 + c, AT + timedelta(hours=n), rng.choice(["pass", "pass", "fail", "error", "warn"])) for n in range(7) for c in range(40)]
    all_runs = spark.createDataFrame(history, "check_id int, dataset_id long, severity string, run_id long, started_at timestamp_ntz, status string")
    state = runs.empty_incidents(all_runs)
    for n in range(7):
        state = spark.createDataFrame(incidents.after_runs(state, all_runs.filter(F.col("started_at") == F.lit(AT + timedelta(hours=n)).cast("timestamp_ntz"))).collect(), runs.INCIDENTS + ", kind string")
    whole = incidents.incident_state(incidents.incident_moves(all_runs))
    names = sorted(whole.columns)
    assert sorted(map(str, state.select(names).collect())) == sorted(map(str, whole.select(names).collect()))


def test_long_lists_are_joined(people: DataFrame, spark: SparkSession) -> None:
    """A third of the rows holds one value that is not accepted; NULL is never a stranger."""
    rows = people.withColumn("name", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("name")))
    listed = [r["name"] for r in people.select("name").distinct().collect() if r["name"]]
    long = CheckSpec(1, "accepted_values", "name", {"values": listed + [f"x{i}" for i in range(suite.LONG_LIST)]})
    table = CheckSpec(2, "accepted_values", "name", {"values_from": "names", "case_sensitive": False})
    given = {2: spark.createDataFrame([(n.upper(),) for n in listed], "n string")}
    got = {r["check_id"]: (r["rows_evaluated"], r["violation_count"]) for r in suite.run_suite(rows, [long, table], given=given).collect()}
    want = rows.filter("name = 'hot'").count()
    assert got == {1: (100, want), 2: (100, want)}
    _, violations = runs.observed_run(rows, [long, table], AT, ["id"], given)
    assert {r["check_id"]: r["count"] for r in violations.groupBy("check_id").count().collect()} == {1: want, 2: want}
    assert suite.run_suite(rows, [CheckSpec(3, "accepted_values", "name", {"values_from": "names"})]).first()["status"] == "error"
    with pytest.raises(ValueError, match="needs one of"):
        CheckSpec(4, "accepted_values", "name", {"values": []})


def test_a_run_reads_the_sample_of_the_run_before(spark: SparkSession) -> None:
    frame = lambda shift: spark.range(500).select("id", (F.col("id") % 50 + shift).cast("double").alias("v"))
    samples, history = spark.createDataFrame([], drift.SAMPLES), spark.createDataFrame([], "check_id int, run_id long, status string")
    notes = []
    for n, shift, status in ((1, 0, "pass"), (2, 1000, "error"), (3, 0, "pass"), (4, 1000, "fail")):
        verdict, kept = drift.ks_against_prior(frame(shift), "v", ["id"], 1, n, samples, history)
        row = verdict.first()
        notes.append((row["note"], row["status"], row["n_prior"]))
        samples, history = samples.unionByName(kept), history.unionByName(spark.createDataFrame([(1, n, status)], history.schema))
    assert notes == [("baseline captured", "pass", 0), (None, "fail", 500), (None, "pass", 500), (None, "fail", 500)]


def test_proposals_run(people: DataFrame) -> None:
    """Each proposal is a check that the registry takes; a pattern, a closed domain and a contract hold on their own table."""
    df = people.crossJoin(people.select(F.col("id").alias("copy")).filter("copy < 6")).select(
        (F.col("id") * 6 + F.col("copy")).alias("row_id"), F.concat(F.lit("u"), F.col("id"), F.lit("@example.org")).alias("email"), (F.col("id") % 4).cast("string").alias("grade"), F.lit(AT).cast("timestamp_ntz").alias("created_at"),
        F.col("age").cast("double").alias("amount"), (F.col("age") * F.col("copy")).alias("points"),
    )
    freq, name = profile.frequencies(df), F.lit("t").alias("table_name")
    p99 = profile.numeric_quantiles(df, [0.99]).select(name, "column_name", F.col("q").alias("p99"))
    top = profile.top_values(freq).groupBy("column_name").agg(F.collect_list("value").alias("values")).select(name, "*")
    columns = propose.profiled(profile.column_facts(df).select(name, "*"), profile.distinct_counts(freq).select(name, "*"), p99, top)
    knowledge = df.sparkSession.createDataFrame([("t", 12)], "table_name string, freshness_sla_hours int")
    specs = propose.specs(propose.propose_checks(columns, knowledge=knowledge))["t"]
    by = {(s.check_type, s.column): s for s in specs}
    assert set(by[("accepted_values", "grade")].params["values"]) == {"0", "1", "2", "3"} and by[("regex_match", "email")].params["pattern"].startswith("^")
    fresh = by[("freshness", "created_at")]
    assert (fresh.severity, fresh.params["default_max_age_hours"], fresh.params["strategy"]) == ("error", 12, "adaptive")
    assert by[("ml_outlier", None)].params["keys"] == ["row_id"] and by[("schema_contract", None)].params["expected_columns"][0] == {"name": "row_id", "dtype": "bigint"}
    for hours, want in ((11, "pass"), (13, "fail")):
        got = {(r["check_type"], r["column_name"]): r["status"] for r in suite.run_suite(df, [s for s in specs if s.check_type not in ("schema_change", "row_count_anomaly", "distribution_drift")], AT + timedelta(hours=hours)).collect()}
        assert got.pop(("freshness", "created_at")) == want
        got.pop(("ml_outlier", None))
        assert set(got.values()) == {"pass"}


def test_schema_clause(spark: SparkSession) -> None:
    expected = [("Id", "BIGINT", False, True), ("gone", None, None, True), ("optional", None, None, False), ("kind", "string", None, True)]
    fields = "array<struct<name:string,dtype:string,nullable:boolean,required:boolean>>"
    rows = [(1, expected, True, True, False), (2, expected, False, False, True), (3, [], True, True, True), (4, None, True, True, True), (5, expected[3:], False, False, False)]
    declared = spark.createDataFrame(rows, f"contract_id long, expected {fields}, compare_types boolean, enforce_nullable boolean, allow_extra boolean")
    now = [("id", "bigint", True), ("kind", "int", True), ("more", "int", True)]
    current = spark.createDataFrame([(i, now) for i in (1, 2, 3, 4)] + [(5, now[1:2])], "contract_id long, columns array<struct<name:string,dtype:string,nullable:boolean>>")
    got = {r["contract_id"]: (r["clause_status"], r["problems"]) for r in contracts.schema_clauses(declared, current).collect()}
    assert got[1] == ("breached", ["gone is missing", "kind has another type", "Id differs in nullability", "more is not declared"])
    assert got[2] == ("breached", ["gone is missing"])
    assert got[3] == got[4] == ("unknown", []) and got[5] == ("pass", [])


def test_fingerprints_are_packed_and_violating_rows_stay_out_of_the_state(people: DataFrame, spark: SparkSession) -> None:
    """Digests take half their letters in the stored state; other texts come back as they are."""
    texts = ["ab" * 32, "AB" * 32, "a" * 31, "f1", "", "\u00e9", "0" * 64, "ab" * 16]
    frame = spark.createDataFrame([(t,) for t in texts], "f string").select("f", fingerprint.packed(F.col("f")).alias("p"))
    assert all(r["f"] == r["u"] for r in frame.withColumn("u", fingerprint.unpacked(F.col("p"))).collect())
    assert frame.filter(F.octet_length("p") == 32).count() == 2
    check = [CheckSpec(2, "range", "age", {"max": 95})]
    one = runs.run_pipeline(people, check, 1, AT, identity=["id"])
    stored = [spark.read.parquet(f).schema["fingerprint"].dataType.simpleString() for f in one.state.inputFiles()]
    assert stored and set(stored) == {"binary"}
    assert {r["fingerprint"] for r in one.state.collect()} == {r["fingerprint"] for r in one.violations.collect()}
    odd = one.state.withColumn("fingerprint", F.concat(F.lit("x"), F.substring("fingerprint", 1, 9)))
    two = runs.run_pipeline(people, check, 2, AT, odd.select(one.state.columns), one.incidents, ["id"])
    assert {r["fingerprint"] for r in odd.collect()} <= {r["fingerprint"] for r in two.state.collect()} and two.state.count() == 2 * one.state.count()

"""Monitoring data derived from the ``events`` table, so that every history query grows with it.

Each user's events are a *feed*, that is a monitored dataset with five checks. A run covers one feed and
one eight-hour slot; violating events are exceptions. The same definitions exist as SQL in ``feeds_sql``.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.ranks import run_status
from plumbline.functions.text import slug
from plumbline.sources.readers import load

AS_OF = datetime(2024, 1, 31)
FIRST = datetime(2024, 1, 1)


def moment(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def _case(key: Column, values: list[str]) -> Column:
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:-1], start=1):
        out = out.when(key == i, v)
    return out.otherwise(values[-1])


class Data:
    """The given tables and the feeds derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small fixed dimension."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def feeds(self) -> DataFrame:
        return self.events.select("user_id").distinct()

    @cached_property
    def slots(self) -> DataFrame:
        """Per feed and slot, all five measures from one aggregation."""
        v = F.col("value")
        grouped = self.events.groupBy("user_id", F.window("ts", "8 hours").alias("_w")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.max("ts").alias("latest"),
            F.max("value").alias("max_value"),
            F.count_if(v > 120).alias("v1"),
            F.count_if(F.col("event_type") == "error").alias("v2"),
            F.count_if(v < 2).alias("v3"),
            F.count_if(F.char_length("props") < 9).alias("v4"),
        )
        start = F.col("_w.start").cast("timestamp_ntz")
        return grouped.withColumn("started_at", start).withColumn(
            "slot", F.floor(F.timestamp_diff("HOUR", moment(FIRST), F.col("started_at")) / 8)
        ).drop("_w")

    @cached_property
    def datasets(self) -> DataFrame:
        u = F.col("user_id")
        return self.feeds.select(
            u.alias("dataset_id"),
            F.concat(F.lit("feed_"), u.cast("string")).alias("table_name"),
            (u % 5).alias("connection_id"),
            F.concat(F.lit("conn_"), (u % 5).cast("string")).alias("connection_name"),
            _case(u % 5, ["", "Commerce", "Growth", "Risk", "Ops"]).alias("domain"),
            _case(u % 3, ["", "Core", "Edge"]).alias("team"),
            _case(u % 4, ["", "ana", "bo", "cy"]).alias("owner"),
            _case(u % 4, ["critical", "high", "medium", "low"]).alias("importance"),
            F.when(u % 6 == 0, 97.5).alias("slo_target_score"),
            (u % 9 != 0).alias("slo_enabled"),
            (u % 17 == 0).alias("is_favorite"),
        )

    def _kinds(self) -> Column:
        u = F.col("user_id")

        def kind(n: int, check_type: str, column: str | None, severity: str, tolerance: int, status: Column) -> Column:
            return F.struct(
                F.lit(n).alias("n"),
                F.lit(check_type).alias("check_type"),
                F.lit(column).cast("string").alias("column_name"),
                F.lit(severity).alias("severity"),
                F.lit(tolerance).alias("tolerance"),
                status.alias("status"),
            )

        active = F.lit("active")
        return F.array(
            kind(1, "range", "value", "error", 0, active),
            kind(2, "accepted_values", "event_type", "warn", 0, F.when(u % 13 == 0, "disabled").otherwise("active")),
            kind(3, "range", "value", "info", 0, F.when(u % 11 == 0, "archived").otherwise("active")),
            kind(4, "string_length", "props", "error", 1, F.when(u % 7 == 0, "proposed").otherwise("active")),
            kind(5, "row_count_min", None, "warn", 0, active),
        )

    @cached_property
    def checks(self) -> DataFrame:
        u = F.col("user_id")
        return self.feeds.select(u, F.explode(self._kinds()).alias("k")).select(
            (u * 10 + F.col("k.n")).alias("check_id"),
            u.alias("dataset_id"),
            F.concat(F.lit("feed "), u.cast("string"), F.lit(" "), F.col("k.check_type"), F.lit(" "), F.col("k.n").cast("string")).alias("check_name"),
            "k.check_type",
            "k.column_name",
            "k.severity",
            "k.tolerance",
            "k.status",
        )

    @cached_property
    def check_runs(self) -> DataFrame:
        """One row per check and slot; a fused aggregation exploded, so events are read once."""
        u = F.col("user_id")
        small = F.when(F.col("row_count") < 2, 1).otherwise(0).cast("bigint")

        def line(n: int, check_type: str, severity: str, tolerance: int, count: Column, error: Column) -> Column:
            rows = F.col("row_count")
            return F.struct(
                (u * 10 + n).alias("check_id"),
                F.lit(check_type).alias("check_type"),
                F.lit(severity).alias("severity"),
                F.when(~error, rows).alias("rows_evaluated"),
                F.when(error, 0).otherwise(count).cast("bigint").alias("violation_count"),
                F.when(error, "error").otherwise(run_status(count, F.lit(tolerance), F.lit(severity))).alias("status"),
            )

        no = F.lit(False)
        lines = F.array(
            line(1, "range", "error", 0, F.col("v1"), no),
            line(2, "accepted_values", "warn", 0, F.col("v2"), no),
            line(3, "range", "info", 0, F.col("v3"), F.col("max_value") > 250),
            line(4, "string_length", "error", 1, F.col("v4"), no),
            line(5, "row_count_min", "warn", 0, small, no),
        )
        return self.slots.select(u.alias("dataset_id"), "started_at", "slot", F.explode(lines).alias("r")).select(
            "r.check_id",
            "dataset_id",
            "r.check_type",
            "r.severity",
            (F.col("r.check_id") * 1000 + F.col("slot")).alias("run_id"),
            "started_at",
            "r.rows_evaluated",
            "r.violation_count",
            "r.status",
        )

    @cached_property
    def exceptions(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        slot = F.floor(F.timestamp_diff("HOUR", moment(FIRST), F.col("ts")) / 8)
        run = (u * 10 + 1) * 1000 + slot
        status = _case(e % 5, ["open", "open", "acknowledged", "expected", "resolved"])
        marked = (e % 5 == 4) | (e % 6 == 0)
        return self.events.filter(F.col("value") > 120).select(
            e.alias("exception_id"),
            (u * 10 + 1).alias("check_id"),
            u.alias("dataset_id"),
            run.alias("run_id"),
            (run + e % 3).alias("last_run_id"),
            F.sha2(F.concat((u * 10 + 1).cast("string"), F.lit("|"), e.cast("string")), 256).alias("fingerprint"),
            F.concat(F.lit("value out of range for user "), u.cast("string")).alias("reason"),
            F.when(e % 7 == 0, "seen before").alias("note"),
            status.alias("status"),
            (e % 3 + 1).alias("occurrence_count"),
            F.nullif(e % 4, F.lit(0)).alias("assigned_to_id"),
            F.col("ts").alias("first_seen_at"),
            (F.col("ts") + F.make_dt_interval(hours=(e % 3).cast("int"))).alias("last_seen_at"),
            F.when(marked, F.col("ts") + F.make_dt_interval(hours=F.lit(6))).alias("marked_at"),
            (e % 2 + 1).alias("version"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        u = F.col("user_id")
        everywhere = self.values(
            [(1, None, "error", "slack", True, True, 1440, 30, 2), (2, None, "warn", "email", True, False, 2160, 0, 0)],
            "rule_id bigint, dataset_id bigint, min_severity string, channel string, enabled boolean, on_error_runs boolean, "
            "dedupe_window_minutes int, escalation_delay_minutes int, max_escalation_level int",
        )
        scoped = self.feeds.filter(u % 10 == 0).select(
            (u + 100).alias("rule_id"),
            u.alias("dataset_id"),
            F.lit("info").alias("min_severity"),
            F.lit("webhook").alias("channel"),
            (u % 4 != 0).alias("enabled"),
            F.lit(False).alias("on_error_runs"),
            F.when(u % 40 != 0, 960).alias("dedupe_window_minutes"),
            F.lit(15).alias("escalation_delay_minutes"),
            F.lit(1).alias("max_escalation_level"),
        )
        return everywhere.unionByName(scoped)

    @cached_property
    def users(self) -> DataFrame:
        return self.values(
            [(1, "ana", True, "admin"), (2, "bo", False, "editor"), (3, "cy", True, "viewer"), (7, "di", True, "editor"), (8, "el", True, "viewer")],
            "user_id bigint, user_name string, is_active boolean, user_role string",
        )

    @cached_property
    def grants(self) -> DataFrame:
        return self.values([(7, 1, "viewer"), (7, 2, "editor"), (8, 2, "editor")], "user_id bigint, connection_id bigint, grant_role string")

    @cached_property
    def slas(self) -> DataFrame:
        u = F.col("user_id")

        def sla(n: int, scope: str, scope_id: Column, target: str, objective: float, days: int, where: Column) -> Column:
            return F.when(
                where,
                F.struct(
                    (u * 10 + n).alias("sla_id"),
                    F.lit(scope).alias("scope"),
                    scope_id.alias("scope_id"),
                    F.lit(target).alias("target_type"),
                    F.lit(objective).alias("objective"),
                    F.lit(days).alias("window_days"),
                ),
            )

        yes = F.lit(True)
        made = F.array(
            sla(1, "dataset", u, "check_success", 0.9, 7, yes),
            sla(2, "check", u * 10 + 1, "check_success", 0.95, 30, yes),
            sla(3, "dataset", u, "volume", 0.5, 30, u % 2 == 0),
            sla(4, "dataset", u, "freshness", 0.99, 30, u % 5 == 0),
            sla(5, "check", u * 10 + 1, "check_success", 1.0, 7, u % 3 == 0),
        )
        return self.feeds.select(F.explode(F.array_compact(made)).alias("s")).select("s.*")

    @cached_property
    def clauses(self) -> DataFrame:
        return self.checks.filter(F.col("status").isin("active", "proposed")).select(
            F.col("dataset_id").alias("contract_id"), slug(F.col("check_name")).alias("clause_id"), "check_type", "check_id"
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """The shape each feed had on each day: one column per event type seen, in order of first arrival."""
        day = F.to_date("ts")
        typed = self.events.groupBy("user_id", day.alias("day"), F.col("event_type").alias("name")).agg(
            F.min(F.struct("ts", "event_id")).alias("_first"),
            F.when(F.max("value") >= 100, "bigint").otherwise("int").alias("dtype"),
            (F.min("value") < 5).alias("nullable"),
        )
        # A feed's day has as many rows here as there are event types.
        place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("_first")) - 1
        column = F.struct(F.col("ordinal"), F.col("name"), F.col("dtype"), F.col("nullable"))
        return (
            typed.withColumn("ordinal", place)
            .groupBy(F.col("user_id").alias("dataset_id"), "day")
            .agg(F.array_sort(F.collect_list(column)).alias("columns"))
            .withColumn("snapshot_id", F.unix_date("day"))
            .withColumn("is_baseline", F.pmod(F.col("snapshot_id"), F.lit(10)) == 0)
        )

"""Streaming queries: each drains the events as a stream and returns what the stream wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.spec import CheckSpec
from plumbline.plans.feeds import Data
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query
from plumbline.session import run_folder
from plumbline.streaming import incidents, monitors


@query(
    "stream_suite",
    """select 1 as check_id, 'range' as check_type, count(*) as rows_evaluated, count(*) filter (where value > 120) as violation_count, case when count(*) filter (where value > 120) = 0 then 'pass' else 'fail' end as status from events
    union all select 2, 'accepted_values', count(*), count(*) filter (where event_type = 'error'), case when count(*) filter (where event_type = 'error') = 0 then 'pass' else 'warn' end from events""",
)
def stream_suite(d: Data) -> DataFrame:
    specs = [
        CheckSpec(1, "range", "value", {"max": 120}),
        CheckSpec(2, "accepted_values", "event_type", {"values": ["click", "view", "purchase", "signup"]}, "warn"),
    ]
    rows = monitors.suite_per_batch(monitors.file_stream(d.spark, d.folder, "events"), specs, run_folder(d.spark, "suite"))
    return rows.select("check_id", "check_type", "rows_evaluated", "violation_count", "status")


@query(
    "stream_volume_tumbling",
    """select window_start, window_start + interval '1 day' as window_end, count(*) as rows_evaluated, count(*) filter (where value > 120) as violation_count
    from (select *, date_trunc('day', ts) as window_start from events) group by 1 having window_start + interval '1 day' <= (select max(ts) from events) - interval '10 minutes'""",
)
def stream_volume_tumbling(d: Data) -> DataFrame:
    stream = monitors.timed(monitors.file_stream(d.spark, d.folder, "events"), "ts", "10 minutes")
    return monitors.drain(monitors.volume(stream, "ts", F.col("value") > 120), "tumbling")


@query(
    "stream_volume_sliding",
    """select window_start, window_start + interval '1 day' as window_end, count(*) as rows_evaluated, count(*) filter (where event_type = 'error') as violation_count
    from (select *, unnest([b, b - interval '6 hours', b - interval '12 hours', b - interval '18 hours']) as window_start from (select *, time_bucket(interval '6 hours', ts, timestamp '2024-01-01') as b from events))
    group by 1 having window_start + interval '1 day' <= (select max(ts) from events) - interval '10 minutes'""",
)
def stream_volume_sliding(d: Data) -> DataFrame:
    stream = monitors.timed(monitors.file_stream(d.spark, d.folder, "events"), "ts", "10 minutes")
    return monitors.drain(monitors.volume(stream, "ts", F.col("event_type") == "error", "1 day", "6 hours"), "sliding")


@query(
    "stream_sessions",
    """select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as events
    from (select *, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id) as s
      from (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes', true) as gap from events))
    group by user_id, s having max(ts) + interval '30 minutes' <= (select max(ts) from events) - interval '10 minutes'""",
)
def stream_sessions(d: Data) -> DataFrame:
    stream = monitors.timed(monitors.file_stream(d.spark, d.folder, "events"), "ts", "10 minutes")
    return monitors.drain(monitors.sessions(stream, "ts", "user_id"), "sessions")


@query("stream_dedup", "select sha256(user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d')) as fingerprint from events where value > 120 group by 1")
def stream_dedup(d: Data) -> DataFrame:
    stream = monitors.timed(monitors.file_stream(d.spark, d.folder, "events"), "ts", "60 days").filter(F.col("value") > 120)
    mark = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256)
    return monitors.drain(monitors.first_sightings(stream, mark), "dedup").select("fingerprint")


@query(
    "stream_incidents",
    with_ctes("moves", body="select check_id, run_id, started_at, status as run_status, kind, cast(episode as int) as episode, cast(occurrence_count as int) as occurrence_count from moves"
    " where started_at <= (select max(started_at) from check_runs) - interval '1 hour'"),
)
def stream_incidents(d: Data) -> DataFrame:
    """The runs come in several files, in no order; those of the last hour still wait for the watermark."""
    history = f"{run_folder(d.spark, 'runs')}/history"
    d.check_runs.select("check_id", "run_id", "started_at", "status").repartition(4, "run_id").write.parquet(history)
    before = d.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", incidents.ROCKSDB)
    try:
        runs = d.spark.readStream.schema(d.spark.read.parquet(history).schema).parquet(history)
        return monitors.drain(incidents.incident_stream(runs), "incidents")
    finally:
        d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

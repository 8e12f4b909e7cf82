"""Two runs of a suite over ``lineitem``, with an analyst's decisions between them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import runs
from plumbline.operators.spec import CheckSpec
from plumbline.plans.feeds import Data, moment
from plumbline.plans.registry import query

FIRST, SECOND = datetime(1995, 2, 1), datetime(1999, 1, 1)
RUNS = [(1, datetime(2003, 1, 1)), (2, datetime(2003, 1, 2))]
KEY = ["l_orderkey", "l_linenumber"]
SUITE = [
    CheckSpec(1, "not_null", "l_orderkey"),
    CheckSpec(2, "range", "l_quantity", {"min": 1, "max": 49}),
    CheckSpec(3, "range", "l_discount", {"max": 0.09}, "warn"),
    CheckSpec(4, "accepted_values", "l_linestatus", {"values": ["o", "f"], "case_sensitive": False}),
    CheckSpec(5, "range", "l_shipdate", {"min": FIRST}),
    CheckSpec(6, "freshness", "l_shipdate", {"max_age_hours": 24}),
    CheckSpec(7, "range", "l_missing", {"min": 0}),
    CheckSpec(8, "unique", "l_extendedprice", severity="info"),
    CheckSpec(9, "custom_sql", params={"sql": "SELECT * FROM source WHERE l_quantity >= 45 AND l_tax > 0.07"}, name="large and taxed"),
    CheckSpec(10, "range", "l_tax", {"max": 0.05}, tolerance=10**9),
]
#: What the twin knows of each check: severity, tolerance, and where rows violate.
_ROWS = [
    (1, "error", 0, "l_orderkey is null"), (2, "error", 0, "l_quantity < 1 or l_quantity > 49"), (3, "warn", 0, "l_discount > 0.09::double"), (4, "error", 0, "lower(l_linestatus) not in ('o', 'f')"),
    (5, "error", 0, f"l_shipdate < timestamp '{FIRST}'"), (8, "info", 0, "l_extendedprice in (select l_extendedprice from {t} group by 1 having count(*) > 1)"),
    (9, "error", 0, "l_quantity >= 45 and l_tax > 0.07::double"), (10, "error", 10**9, "l_tax > 0.05::double"),
]
_COUNT = {8: "count(l_extendedprice) - count(distinct l_extendedprice)"}
_STALE = "count(*) filter (where l_shipdate <= timestamp '{at}') = 0 or date_diff('second', max(l_shipdate) filter (where l_shipdate <= timestamp '{at}'), timestamp '{at}') > 86400"


def _run_sql(n: int) -> str:
    table, at = f"l{n}", RUNS[n - 1][1]
    measured = [f"select {i} as check_id, '{sev}' as severity, {tol} as tolerance, cast({_COUNT.get(i, f'count(*) filter (where {where})')} as bigint) as violations from {table}" for i, sev, tol, where in _ROWS]
    measured.append(f"select 6, 'error', 0, cast(case when {_STALE.format(at=at)} then 1 else 0 end as bigint) from {table}")
    measured.append(f"select 7, 'error', 0, null from (select count(*) from {table})")
    found = [
        f"select {i} as check_id, sha256('{i}|{{\"l_linenumber\":\"' || l_linenumber || '\",\"l_orderkey\":\"' || l_orderkey || '\"}}') as fingerprint from {table} where {where.format(t=table)}"
        for i, _, _, where in _ROWS
    ]
    return f"""r{n} as (select check_id, violations, case when violations is null then 'error' when violations <= tolerance then 'pass' when severity = 'error' then 'fail' else 'warn' end as status
      from ({' union all '.join(measured)})),
    v{n} as (select check_id, fingerprint, count(*) as n from ({' union all '.join(found)}) join r{n} using (check_id) where status in ('fail', 'warn') group by 1, 2)"""


RUN_SQL = f"""with l1 as (select * from lineitem where l_shipdate < timestamp '{SECOND}'), l2 as (select * from lineitem where l_shipdate >= timestamp '{FIRST}'),
    {_run_sql(1)}, {_run_sql(2)},
    state as (select check_id, fingerprint, case when fingerprint[1] in ('0', '1') then 'resolved' when fingerprint[1] = '2' then 'expected' when fingerprint[1] = '3' then 'acknowledged' else 'open' end as status from v1),
    merged as (select check_id, fingerprint, s.status as before, v.n, s.fingerprint is not null as known, v.fingerprint is not null as seen from state s full outer join v2 v using (check_id, fingerprint)),
    judged as (select *, case when not seen then 'unseen' when not known then 'new' when before = 'expected' then 'suppressed' when before = 'resolved' then 'regressed' else 'bumped' end as outcome,
      case when not known or (seen and before = 'resolved') then 'open' else before end as reopened from merged),
    closed as (select j.*, reopened = 'open' and r.status = 'pass' and r.check_id <> 6 as shut from judged j join r2 r using (check_id)),
    totals as (select check_id, sum(n) as recorded, count(*) filter (where outcome = 'new') as new_count, count(*) filter (where outcome = 'bumped') as bumped_count, count(*) filter (where outcome = 'suppressed') as suppressed_count,
      count(*) filter (where outcome = 'regressed') as regressed_count, count(*) filter (where shut) as auto_resolved_count, count(*) filter (where reopened = 'open' and not shut) as open_count from closed group by 1),
    moves as (select b.check_id, b.violations, b.status, a.status in ('fail', 'error') as was, b.status in ('fail', 'error') as is_ from r1 a join r2 b using (check_id))
    select check_id, status, violations as violation_count, cast(coalesce(recorded, 0) as bigint) as recorded, coalesce(new_count, 0) as new_count, coalesce(bumped_count, 0) as bumped_count, coalesce(suppressed_count, 0) as suppressed_count,
    coalesce(regressed_count, 0) as regressed_count, coalesce(auto_resolved_count, 0) as auto_resolved_count, coalesce(open_count, 0) as open_count, coalesce(regressed_count, 0) + coalesce(auto_resolved_count, 0) as event_count,
    case when is_ and was then 'occurred' when is_ then 'opened' when was and status = 'pass' then 'recovered' end as move, case when was and status = 'pass' then 'resolved' when was or is_ then 'open' end as incident_status,
    case when was or is_ then was::bigint + is_::bigint end as failures from moves left join totals using (check_id)"""


@query("run_pipeline", RUN_SQL)
def run_pipeline(d: Data) -> DataFrame:
    """What the second run does, by check: results, exceptions and incidents."""
    lines = d.table("lineitem")
    first = runs.run_pipeline(lines.filter(F.col("l_shipdate") < moment(SECOND)), SUITE, *RUNS[0], identity=KEY)
    lead = F.substring("fingerprint", 1, 1)
    decided = F.when(lead.isin("0", "1"), "resolved").when(lead == "2", "expected").when(lead == "3", "acknowledged").otherwise(F.col("status"))
    second = runs.run_pipeline(lines.filter(F.col("l_shipdate") >= moment(FIRST)), SUITE, *RUNS[1], first.state.withColumn("status", decided), first.incidents, KEY)
    kinds = ("new", "bumped", "suppressed", "regressed")
    records = second.state.groupBy("check_id").agg(
        *[F.count_if(F.col("outcome") == k).alias(f"{k}_count") for k in kinds], F.count_if("auto_resolved").alias("auto_resolved_count"), F.count_if(F.col("status") == "open").alias("open_count")
    )
    recorded = second.violations.groupBy("check_id").agg(F.count(F.lit(1)).alias("recorded"))
    events = second.events.groupBy("check_id").agg(F.count(F.lit(1)).alias("event_count"))
    moved = second.incidents.select("check_id", F.col("kind").alias("move"), F.col("status").alias("incident_status"), F.col("occurrence_count").alias("failures"))
    out = second.results.select("check_id", "status", "violation_count")
    for part in (recorded, records, events):
        out = out.join(part, "check_id", "left")
    out = out.na.fill(0, ["recorded", "event_count", "auto_resolved_count", "open_count", *[f"{k}_count" for k in kinds]])
    return out.join(moved, "check_id", "left")

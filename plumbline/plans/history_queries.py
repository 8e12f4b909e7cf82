"""Run history: latest and as-of status, dashboards, status page, scorecards and service levels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import contracts, incidents, insights, joins, schemachecks, scorecards, sla
from plumbline.plans.check_queries import CHANGES, PAIRS
from plumbline.plans.feeds import AS_OF, FIRST, Data
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query

@query("latest_statuses", with_ctes("latest", body="select check_id, started_at, run_id, status from latest"))
def latest_statuses(d: Data) -> DataFrame:
    return scorecards.latest_statuses(d.check_runs)


@query("latest_run", with_ctes("check_runs", body="select check_id, max(run_id) as run_id, arg_max(status, run_id) as status, arg_max(violation_count, run_id) as violation_count from check_runs group by 1"))
def latest_run(d: Data) -> DataFrame:
    return contracts.latest_runs(d.check_runs.select("check_id", "run_id", "status", "violation_count"))


ASOF = """, days as (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day),
    grid as (select c.check_id, day from (select distinct check_id from check_runs) c, days)
    select g.check_id, g.day, r.status, r.run_id from grid g asof join check_runs r on g.check_id = r.check_id and g.day + interval '1 day' - interval '1 microsecond' >= r.started_at"""


@query("asof_status_daily", with_ctes("check_runs", body=ASOF))
def asof_status_daily(d: Data) -> DataFrame:
    return joins.status_as_of_days(d.check_runs, ["check_id"], F.lit(date(2024, 1, 30)))


@query(
    "check_matrix",
    with_ctes("check_runs", "checks", body="""select c.check_id, c.severity, day, case max(case r.status when 'pass' then 0 when 'warn' then 1 when 'fail' then 2 when 'error' then 3 end)
    when 0 then 'pass' when 1 then 'warn' when 2 then 'fail' when 3 then 'error' end as status, count(r.run_id) as runs
    from (select * from checks where status = 'active') c cross join (select unnest(generate_series(date '2024-01-18', date '2024-01-31', interval 1 day))::date as day)
    left join check_runs r on r.check_id = c.check_id and cast(r.started_at as date) = day group by all"""),
)
def check_matrix(d: Data) -> DataFrame:
    return insights.check_matrix(d.checks.filter(F.col("status") == "active"), d.check_runs, AS_OF, 14)


@query(
    "exception_series",
    with_ctes("exceptions", body="""select day, count(exception_id) as n from (select unnest(generate_series(date '2024-01-02', date '2024-01-31', interval 1 day))::date as day)
    left join exceptions on cast(first_seen_at as date) = day and status = 'open' group by 1"""),
)
def exception_series(d: Data) -> DataFrame:
    return insights.exception_series(d.exceptions.filter(F.col("status") == "open"), AS_OF, 30)


@query(
    "status_trend",
    with_ctes("check_runs", body="""select day, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'warn') as warned, count(*) filter (where status = 'fail') as failed,
    count(*) filter (where status = 'error') as errored from (select unnest(generate_series(date '2024-01-18', date '2024-01-31', interval 1 day))::date as day)
    left join check_runs on cast(started_at as date) = day group by 1"""),
)
def status_trend(d: Data) -> DataFrame:
    return insights.status_trend(d.check_runs, AS_OF, 14)


@query(
    "kpi_summary",
    with_ctes("check_runs", "checks", "exceptions", "latest", body="""select 'datasets' as metric, count(distinct dataset_id)::double as value from checks
    union all select 'active_checks', count(*) from checks where status = 'active'
    union all select 'proposed_checks', count(*) from checks where status = 'proposed'
    union all select 'failing_checks', count(*) from checks c join latest l using (check_id) where c.status = 'active' and l.status in ('fail', 'error')
    union all select 'runs_24h', count(*) from check_runs where started_at >= timestamp '2024-01-30'
    union all select 'pass_rate_7d', round(count(*) filter (where status = 'pass') / count(*), 4) from check_runs where started_at >= timestamp '2024-01-24'
    union all select 'open_exceptions', count(*) from exceptions where status = 'open'"""),
)
def kpi_summary(d: Data) -> DataFrame:
    return insights.kpi_summary(d.checks, d.check_runs, d.exceptions, scorecards.latest_statuses(d.check_runs), AS_OF)


@query(
    "console_counts",
    with_ctes("exceptions", body="""select count(*) filter (where first_seen_at >= timestamp '2024-01-30') as new_exceptions_24h,
    count(*) filter (where status = 'resolved' and marked_at >= timestamp '2024-01-30') as resolved_24h,
    count(*) filter (where status = 'open' and occurrence_count > 1 and marked_at is not null) as regressed_open,
    count(*) filter (where status = 'open' and assigned_to_id = 1) as assigned_to_me_open, count(*) filter (where status = 'open') as open_total from exceptions"""),
)
def console_counts(d: Data) -> DataFrame:
    return insights.console_counts(d.exceptions, 1, AS_OF)


@query(
    "dataset_movers",
    with_ctes("exceptions", body="""select dataset_id, count(*) filter (where first_seen_at >= timestamp '2024-01-30') as opened_24h,
    count(*) filter (where status = 'resolved' and marked_at >= timestamp '2024-01-30') as resolved_24h, count(*) filter (where status = 'open') as open_total
    from exceptions group by 1 having opened_24h > 0 order by opened_24h desc, dataset_id limit 5"""),
)
def dataset_movers(d: Data) -> DataFrame:
    return insights.dataset_movers(d.exceptions, AS_OF)


def _moves(d: Data) -> DataFrame:
    return incidents.incident_moves(d.check_runs)


@query("incident_activity", with_ctes("incidents", body="select cast(first_seen_at as date) as day, count(*) as n from incidents where first_seen_at >= timestamp '2023-11-02' group by 1"))
def incident_activity(d: Data) -> DataFrame:
    return insights.incident_activity(incidents.incident_state(_moves(d)), "first_seen_at", AS_OF)


@query(
    "incident_heatmap",
    with_ctes("moves", body="""select day, coalesce(n, 0) as n, cast(case when coalesce(n, 0) <= 2 then coalesce(n, 0) when n <= 4 then 3 else 4 end as int) as heat
    from (select unnest(generate_series(date '2023-11-02', date '2024-01-31', interval 1 day))::date as day)
    left join (select cast(started_at as date) as day, count(*) as n from moves where kind = 'opened' group by 1) using (day)"""),
)
def incident_heatmap(d: Data) -> DataFrame:
    opened = _moves(d).filter(F.col("kind") == "opened")
    return insights.heat_map(insights.incident_activity(opened, "started_at", AS_OF), AS_OF)


@query("open_exceptions", with_ctes("exceptions", body="select dataset_id, count(*) as open_exceptions from exceptions where status = 'open' group by 1"))
def open_exceptions(d: Data) -> DataFrame:
    return scorecards.open_exceptions(d.exceptions)


@query("exceptions_per_run", with_ctes("exceptions", "check_runs", body="select r.run_id, r.check_id, count(e.exception_id) as exceptions from check_runs r left join exceptions e on e.run_id = r.run_id where r.status = 'fail' group by 1, 2"))
def exceptions_per_run(d: Data) -> DataFrame:
    counts = d.exceptions.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    failed = d.check_runs.filter(F.col("status") == "fail").select("run_id", "check_id")
    return failed.join(counts, "run_id", "left").select("run_id", "check_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("exceptions"))


SCORE_COLUMNS = [
    "dataset_id", "table_name", "domain", "team", "owner", "importance", "base_score", "exception_penalty", "score", "slo_target", "slo_status", "score_gap",
    "active_checks", "passing_checks", "warning_checks", "failing_checks", "error_checks", "unknown_checks", "open_exceptions",
]


def scores(d: Data) -> DataFrame:
    return scorecards.dataset_scores(d.datasets, d.checks, scorecards.latest_statuses(d.check_runs), scorecards.open_exceptions(d.exceptions))


@query("dataset_scores", with_ctes("scores", body=f"select {', '.join(SCORE_COLUMNS)} from scores"))
def dataset_scores(d: Data) -> DataFrame:
    return scores(d).select(*SCORE_COLUMNS)


def _rollup_sql(source: str, extra: str = "") -> str:
    by = f"{extra}, " if extra else ""
    return f"""select {by}grain, key, case when grain = 'global' then 'All datasets' when key = '' then 'Unassigned' else key end as label, score, slo_target,
    case when targets = 0 and disabled then 'disabled' when score is null or slo_target is null then 'unknown' when round(score - slo_target, 2) >= 0 then 'met'
      when round(score - slo_target, 2) >= -2 then 'at_risk' else 'breached' end as slo_status,
    case when targets = 0 and disabled then null else round(score - slo_target, 2) end as score_gap, total_datasets, scored_datasets, active_checks, passing_checks, warning_checks,
    failing_checks, error_checks, unknown_checks, open_exceptions, slo_met, slo_at_risk, slo_breached, slo_unknown, slo_disabled
    from (select {by}grain, key, round(sum(round(score * 100) * importance_weight) / nullif(sum(importance_weight) filter (where score is not null), 0)) / 100 as score,
      round(sum(round(slo_target * 100) * importance_weight) filter (where slo_status <> 'disabled') / nullif(sum(importance_weight) filter (where slo_target is not null and slo_status <> 'disabled'), 0)) / 100 as slo_target,
      count(*) as total_datasets, count(score) as scored_datasets, count(*) filter (where slo_target is not null and slo_status <> 'disabled') as targets, bool_and(slo_status = 'disabled') as disabled,
      {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in SCORE_COLUMNS[12:])},
      {", ".join(f"count(*) filter (where slo_status = '{x}') as slo_{x}" for x in ("met", "at_risk", "breached", "unknown", "disabled"))}
      from (select 'global' as grain, '' as key, * from {source} union all select 'domain', domain, * from {source} union all select 'team', team, * from {source}
        union all select 'owner', owner, * from {source} union all select 'importance', importance, * from {source} union all select 'dataset', cast(dataset_id as varchar), * from {source})
      group by {by}grain, key)"""


@query("scorecard_rollups", with_ctes("scores", body=_rollup_sql("scores")))
def scorecard_rollups(d: Data) -> DataFrame:
    return scorecards.rollups(scores(d))


@query(
    "worst_rollups",
    with_ctes("scores", body=f"select grain, key, score, slo_status from ({_rollup_sql('scores')}) where grain in ('domain', 'team') and score is not null order by case slo_status when 'breached' then 0 else 1 end, score, lower(label), grain limit 5"),
)
def worst_rollups(d: Data) -> DataFrame:
    return scorecards.worst_rollups(scorecards.rollups(scores(d))).select("grain", "key", "score", "slo_status")


ATTENTION = "order by score asc nulls last, open_exceptions desc, lower(table_name), dataset_id"


@query("attention_datasets", with_ctes("scores", body=f"select dataset_id, score, open_exceptions from scores where score is not null {ATTENTION} limit 10"))
def attention_datasets(d: Data) -> DataFrame:
    ranked = scores(d).filter(F.col("score").isNotNull()).orderBy(*scorecards.attention_order())
    return ranked.limit(10).select("dataset_id", "score", "open_exceptions")


@query("scorecard_page", with_ctes("scores", body=f"select dataset_id, domain, team, score from scores where lower(domain) = 'growth' {ATTENTION} limit 10 offset 5"))
def scorecard_page(d: Data) -> DataFrame:
    return scorecards.page(scores(d), domain=" Growth ", offset=5, limit=10).select("dataset_id", "domain", "team", "score")


BACKFILL = """, days as (select distinct cast(started_at as date) as day from check_runs),
    act as (select check_id, dataset_id, severity from checks where status = 'active'),
    grid as (select * from act, days),
    st as (select g.*, coalesce(r.status, 'unknown') as s from grid g asof left join check_runs r on g.check_id = r.check_id and g.day + interval '1 day' - interval '1 microsecond' >= r.started_at),
    pts as (select dataset_id, day, sum(w * 2)::double as weight, sum(w * 2 * p * 10)::double as points, count(*) as active_checks, count(*) filter (where s = 'pass') as passing_checks,
      count(*) filter (where s = 'warn') as warning_checks, count(*) filter (where s = 'fail') as failing_checks, count(*) filter (where s = 'error') as error_checks, count(*) filter (where s = 'unknown') as unknown_checks
      from (select *, case severity when 'info' then 0.5 when 'warn' then 1.0 else 2.0 end as w, case s when 'pass' then 1.0 when 'warn' then 0.7 when 'unknown' then 0.5 else 0.0 end as p from st) group by 1, 2),
    daily as (select *, case when not slo_enabled then 'disabled' when score is null then 'unknown' when round(score - slo_target, 2) >= 0 then 'met' when round(score - slo_target, 2) >= -2 then 'at_risk' else 'breached' end as slo_status
      from (select d.dataset_id, p.day, d.domain, d.team, d.owner, d.importance, d.slo_enabled, case d.importance when 'critical' then 4.0::double when 'high' then 3.0 when 'medium' then 2.0 else 1.0 end as importance_weight,
      round(points * 1000 / weight) / 100 as score, case when not slo_enabled then null else coalesce(slo_target_score, case importance when 'critical' then 98.0 when 'high' then 95.0 when 'medium' then 90.0 else 85.0 end) end as slo_target,
      active_checks, passing_checks, warning_checks, failing_checks, error_checks, unknown_checks, 0 as open_exceptions from datasets d join pts p using (dataset_id)))"""


def _backfill(d: Data) -> DataFrame:
    return scorecards.backfill(d.datasets, d.checks, d.check_runs, F.lit(FIRST.date()), F.lit(date(2024, 1, 30)))


@query("scorecard_backfill", with_ctes("check_runs", "checks", "datasets", body=BACKFILL + " " + _rollup_sql("daily", "day")))
def scorecard_backfill(d: Data) -> DataFrame:
    return scorecards.rollups(_backfill(d), ["day"])


@query(
    "scorecard_history",
    with_ctes("check_runs", "checks", "datasets", body=BACKFILL + f" select day, key, score, slo_status from ({_rollup_sql('daily', 'day')}) where grain = 'team' and day >= date '2024-01-17' order by day, key"),
)
def scorecard_history(d: Data) -> DataFrame:
    rolled = scorecards.rollups(_backfill(d), ["day"])
    return scorecards.history(rolled, "team", F.lit(date(2024, 1, 17))).select("day", "key", "score", "slo_status")


JUDGE = """case when good + bad > 0 then round(good / (good + bad), 6) else 1.0 end as attainment,
    round(case when good + bad = 0 then 0.0 when 1.0 - objective <= 0 then case when bad > 0 then 1.0 else 0.0 end else least(2.0, bad / (good + bad) / (1.0 - objective)) end, 6)::double as budget_consumed,
    case when good + bad > 0 then good / (good + bad) else 1.0 end < objective as breached"""

TARGETS = """targets as (select sla_id, scope_id as check_id from slas where scope = 'check'
    union all select sla_id, check_id from slas join checks on scope = 'dataset' and dataset_id = scope_id and (target_type not in ('freshness', 'volume')
      or (target_type = 'freshness' and check_type = 'freshness') or (target_type = 'volume' and check_type in ('row_count_min', 'row_count_anomaly'))))"""

EVALUATE = f""", {TARGETS},
    runs as (select s.sla_id, count(*) filter (where r.status in ('pass', 'warn')) as good, count(*) filter (where r.status in ('fail', 'error')) as bad
      from slas s join targets t using (sla_id) join check_runs r on r.check_id = t.check_id and r.started_at >= timestamp '2024-01-31' - to_days(s.window_days) group by 1),
    fixes as (select s.sla_id, sum(date_diff('second', first_seen_at, marked_at)) as sec, count(*) as fixed
      from slas s join targets t using (sla_id) join exceptions e on e.check_id = t.check_id and e.status = 'resolved' and marked_at >= timestamp '2024-01-31' - to_days(s.window_days) and marked_at >= first_seen_at group by 1),
    evals as (select sla_id, scope, scope_id, objective, window_days, good, bad, {JUDGE}, cast(floor(sec / fixed) as bigint) as mttr_seconds
      from (select s.*, coalesce(good, 0) as good, coalesce(bad, 0) as bad, sec, fixed from slas s left join runs using (sla_id) left join fixes using (sla_id)))"""


@query("sla_evaluations", with_ctes("slas", "checks", "check_runs", "exceptions", body=EVALUATE + " select * from evals"))
def sla_evaluations(d: Data) -> DataFrame:
    return sla.evaluate(d.slas, d.checks, d.check_runs, d.exceptions, AS_OF)


@query("sla_mttr", with_ctes("slas", "checks", "check_runs", "exceptions", body=EVALUATE + " select sla_id, mttr_seconds from evals where mttr_seconds is not null"))
def sla_mttr(d: Data) -> DataFrame:
    return sla_evaluations(d).filter(F.col("mttr_seconds").isNotNull()).select("sla_id", "mttr_seconds")


@query(
    "reliability",
    with_ctes("slas", "checks", "check_runs", "exceptions", body=EVALUATE + " select sla_id, breached, budget_consumed, attainment from evals"),
)
def reliability(d: Data) -> DataFrame:
    return sla.reliability(sla_evaluations(d)).select("sla_id", "breached", "budget_consumed", "attainment")


BURN = f""", {TARGETS},
    daily as (select s.sla_id, s.objective, s.window_days, cast(r.started_at as date) as day, count(*) filter (where r.status in ('pass', 'warn')) as g, count(*) filter (where r.status in ('fail', 'error')) as b
      from slas s join targets t using (sla_id) join check_runs r on r.check_id = t.check_id group by all),
    burn as (select *, {JUDGE} from (select sla_id, objective, window_days, day,
      cast(case when window_days = 7 then sum(g) over w7 else sum(g) over w30 end as bigint) as good, cast(case when window_days = 7 then sum(b) over w7 else sum(b) over w30 end as bigint) as bad from daily
      window w7 as (partition by sla_id order by day range between interval 6 days preceding and current row), w30 as (partition by sla_id order by day range between interval 29 days preceding and current row)))"""


@query("sla_burndown", with_ctes("slas", "checks", "check_runs", body=BURN + " select * from burn"))
def sla_burndown(d: Data) -> DataFrame:
    return sla.burn_down(d.slas, d.checks, d.check_runs)


@query(
    "sla_transitions",
    with_ctes("slas", "checks", "check_runs", body=BURN + " select sla_id, day, attainment from burn qualify breached and not coalesce(lag(breached) over (partition by sla_id order by day), false)"),
)
def sla_transitions(d: Data) -> DataFrame:
    return sla.breach_transitions(sla_burndown(d)).select("sla_id", "day", "attainment")


CONFORM = """, runs as (select check_id, max(run_id) as run_id, arg_max(status, run_id) as rs, arg_max(violation_count, run_id) as violation_count from check_runs group by 1),
    cs as (select c.*, run_id, violation_count, case when rs is null then 'unknown' when rs = 'pass' then 'pass' else 'breached' end as clause_status from clauses c left join runs using (check_id))"""


def _clauses(d: Data) -> DataFrame:
    return contracts.clause_conformance(d.clauses, d.check_runs)


@query("contract_clauses", with_ctes("clauses", "check_runs", body=CONFORM + " select * from cs"))
def contract_clauses(d: Data) -> DataFrame:
    return _clauses(d)


SCHEMA_SQL = """, ends as (select dataset_id, max(snapshot_id) as last, max(snapshot_id) filter (where snapshot_id % 10 = 0) as base from snapshot_columns group by 1),
    old as (select c.* from ends e join snapshot_columns c on c.dataset_id = e.dataset_id and c.snapshot_id = e.base), cur as (select c.* from ends e join snapshot_columns c on c.dataset_id = e.dataset_id and c.snapshot_id = e.last),
    sides as (select coalesce(o.dataset_id, c.dataset_id) as contract_id, o.name as old_name, c.name as new_name, o.dtype as old_type, c.dtype as new_type, o.nullable as old_null, c.nullable as new_null
      from old o full outer join cur c on o.dataset_id = c.dataset_id and o.name = c.name),
    schemas as (select contract_id, case when count(old_name) = 0 then 'unknown' when count(*) filter (where new_name is null or (contract_id % 2 = 0 and old_type <> new_type) or (contract_id % 3 = 0 and old_null <> new_null)
      or (contract_id % 4 = 0 and old_name is null)) > 0 then 'breached' else 'pass' end as clause_status, count(*) filter (where new_name is null) + count(*) filter (where contract_id % 2 = 0 and old_type <> new_type)
      + count(*) filter (where contract_id % 3 = 0 and old_null <> new_null) + count(*) filter (where contract_id % 4 = 0 and old_name is null) as n from sides group by 1)"""


def _schema_clauses(d: Data) -> DataFrame:
    """Each feed's contract expects the columns of its newest baseline; how strictly depends on the contract."""
    newest = d.snapshots.groupBy("dataset_id").agg(F.max_by("columns", "snapshot_id").alias("columns"))
    base = schemachecks.pinned_baseline(d.snapshots, "dataset_id", "snapshot_id").select("dataset_id", F.transform("columns", lambda c: F.struct(c["name"], c["dtype"], c["nullable"], F.lit(True).alias("required"))).alias("expected"))
    of = F.col("dataset_id")
    expected = newest.select("dataset_id").join(base, "dataset_id", "left").select(of.alias("contract_id"), "expected", (of % 2 == 0).alias("compare_types"), (of % 3 == 0).alias("enforce_nullable"), (of % 4 != 0).alias("allow_extra"))
    return contracts.schema_clauses(expected, newest.select(of.alias("contract_id"), "columns"))


@query("contract_schema", with_ctes("snapshot_columns", body=SCHEMA_SQL + " select contract_id, clause_status, case when clause_status = 'breached' then n else 0 end as problems from schemas"))
def contract_schema(d: Data) -> DataFrame:
    return _schema_clauses(d).select("contract_id", "clause_status", F.size("problems").cast("bigint").alias("problems"))


@query(
    "contract_conformance",
    with_ctes("clauses", "check_runs", "snapshot_columns", body=CONFORM + SCHEMA_SQL + """, every as (select contract_id, clause_status from cs union all select contract_id, clause_status from schemas)
    select contract_id, case when bool_or(clause_status = 'breached') then 'breached' when bool_or(clause_status = 'unknown') then 'unknown' else 'pass' end as status,
    count(*) as clauses, count(*) filter (where clause_status = 'breached') as breached_clauses, count(*) filter (where clause_status = 'unknown') as unknown_clauses from every group by 1"""),
)
def contract_conformance(d: Data) -> DataFrame:
    clauses = _clauses(d).select("contract_id", "clause_id", "clause_status")
    return contracts.conformance(clauses.unionByName(_schema_clauses(d).drop("problems")))


@query(
    "lineage_health",
    with_ctes("check_runs", "checks", "exceptions", "datasets", body=""", l as (select check_id, any_value(dataset_id) as dataset_id, arg_max(status, run_id) as s from check_runs group by 1),
    f as (select l.dataset_id, count(*) filter (where c.status = 'active' and l.s = 'fail') as fails from l left join checks c using (check_id) group by 1),
    o as (select dataset_id, count(*) as opens from exceptions where status = 'open' group by 1)
    select dataset_id, case when coalesce(fails, 0) > 0 then 'fail' when coalesce(opens, 0) > 0 then 'warn' when fails is not null then 'pass' else 'unknown' end as health,
    coalesce(fails, 0) as failing_checks, coalesce(opens, 0) as open_exceptions from datasets left join f using (dataset_id) left join o using (dataset_id)"""),
)
def lineage_health(d: Data) -> DataFrame:
    return insights.lineage_health(d.check_runs, d.checks, d.exceptions, d.datasets)


HEALTH = """, health as (select dataset_id, case max(case l.status when 'pass' then 0 when 'warn' then 1 when 'fail' then 2 when 'error' then 3 end) when 0 then 'operational' when 1 then 'delayed'
    when 2 then 'degraded' when 3 then 'degraded' else 'unknown' end as health from checks c left join latest l using (check_id) where c.status = 'active' group by 1)"""


def _health(d: Data) -> DataFrame:
    return insights.dataset_health(d.checks, scorecards.latest_statuses(d.check_runs))


@query(
    "status_tiles",
    with_ctes("checks", "latest", "incidents", "datasets", body=HEALTH + """ select dataset_id, health, table_name, coalesce(n, 0) as open_incidents, last_incident_at from health join datasets using (dataset_id)
    left join (select dataset_id, count(*) filter (where status in ('open', 'acknowledged')) as n, max(last_seen_at) as last_incident_at from incidents group by 1) using (dataset_id)"""),
)
def status_tiles(d: Data) -> DataFrame:
    return insights.status_tiles(_health(d), incidents.incident_state(_moves(d)), d.datasets)


@query(
    "status_overall",
    with_ctes("checks", "latest", body=HEALTH + """ select case when count(*) filter (where health = 'degraded') > 0 then 'degraded' when count(*) filter (where health = 'delayed') > 0 then 'delayed'
    when count(*) filter (where health = 'operational') > 0 then 'operational' else 'unknown' end as overall, count(*) filter (where health = 'operational') as operational,
    count(*) filter (where health = 'delayed') as delayed, count(*) filter (where health = 'degraded') as degraded from health"""),
)
def status_overall(d: Data) -> DataFrame:
    return insights.overall_status(_health(d))


@query(
    "status_updates",
    with_ctes("moves", "datasets", body="""select kind, check_id, table_name, m.severity, started_at from moves m join datasets using (dataset_id)
    where kind in ('opened', 'recovered') order by started_at desc, run_id desc limit 20"""),
)
def status_updates(d: Data) -> DataFrame:
    news = _moves(d).filter(F.col("kind").isin("opened", "recovered")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(20)
    return news.join(d.datasets.select("dataset_id", "table_name"), "dataset_id").select("kind", "check_id", "table_name", "severity", "started_at")


@query(
    "failing_now",
    with_ctes("checks", "latest", body="""select check_id, c.severity, l.status as run_status, started_at from checks c join latest l using (check_id) where c.status = 'active' and l.status in ('fail', 'error')
    order by case c.severity when 'error' then 0 when 'warn' then 1 else 2 end, started_at desc, check_id limit 8"""),
)
def failing_now(d: Data) -> DataFrame:
    return insights.failing_now(d.checks, scorecards.latest_statuses(d.check_runs)).select("check_id", "severity", "run_status", "started_at")


@query("worst_datasets", with_ctes("exceptions", body="select dataset_id, count(*) as open_exceptions from exceptions where status = 'open' group by 1 order by 2 desc, 1 limit 5"))
def worst_datasets(d: Data) -> DataFrame:
    return scorecards.open_exceptions(d.exceptions).orderBy(F.desc("open_exceptions"), F.asc("dataset_id")).limit(5)


@query(
    "recent_failures",
    with_ctes("check_runs", "checks", "datasets", body="""select run_id, check_name, table_name, r.status, violation_count, started_at from
    (select * from check_runs where status in ('fail', 'error') order by run_id desc limit 15) r join (select check_id, check_name from checks) using (check_id) join datasets using (dataset_id)"""),
)
def recent_failures(d: Data) -> DataFrame:
    newest = d.check_runs.filter(F.col("status").isin("fail", "error")).orderBy(F.desc("run_id")).limit(15)
    named = newest.join(d.checks.select("check_id", "check_name"), "check_id").join(d.datasets.select("dataset_id", "table_name"), "dataset_id")
    return named.select("run_id", "check_name", "table_name", "status", "violation_count", "started_at")


HISTORY = """, PAIRS, changes as (CHANGES),
    s as (select distinct dataset_id, day from snapshot_columns), first as (select dataset_id, min(day) as f from s group by 1)
    select s.dataset_id, s.day, case when day > f then coalesce(string_agg(column_name, ',' order by column_name) filter (where change_type = 'added'), '') end as added,
    case when day > f then coalesce(string_agg(column_name, ',' order by column_name) filter (where change_type = 'removed'), '') end as removed,
    cast(case when day > f then count(*) filter (where change_type = 'type_changed') end as int) as type_changed, cast(case when day > f then count(*) filter (where change_type = 'nullability_changed') end as int) as nullability_changed,
    case when day > f then count(*) filter (where change_type = 'reordered') > 0 end as reordered
    from s join first using (dataset_id) left join changes using (dataset_id, day) group by s.dataset_id, s.day, f"""


def _history_sql() -> str:
    return with_ctes("snapshot_columns", body=HISTORY.replace("PAIRS", PAIRS).replace("CHANGES", CHANGES))


@query("schema_history", _history_sql())
def schema_history(d: Data) -> DataFrame:
    return schemachecks.schema_history(d.snapshots, "dataset_id", ["day"], F.trunc("day", "month"))


@query(
    "schema_snapshots_dedup",
    with_ctes("snapshot_columns", body=""", f as (select dataset_id, day, sha256(string_agg(ordinal || ':' || name || ':' || dtype || ':' || nullable, ',' order by ordinal)) as fingerprint from snapshot_columns group by all)
    select * from f qualify lag(fingerprint) over (partition by dataset_id order by day) is distinct from fingerprint"""),
)
def schema_snapshots_dedup(d: Data) -> DataFrame:
    return schemachecks.drop_repeated_snapshots(d.snapshots, "dataset_id", ["day"], F.trunc("day", "month")).select("dataset_id", "day", "fingerprint")


@query(
    "pinned_baseline",
    with_ctes("snapshot_columns", body="""select dataset_id, cast(max(snapshot_id) as int) as snapshot_id, arg_max(names, snapshot_id) as names
    from (select dataset_id, snapshot_id, string_agg(name, ',' order by ordinal) as names from snapshot_columns where snapshot_id % 10 = 0 group by 1, 2) group by 1"""),
)
def pinned_baseline(d: Data) -> DataFrame:
    pinned = schemachecks.pinned_baseline(d.snapshots, "dataset_id", "snapshot_id")
    return pinned.select("dataset_id", "snapshot_id", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"))


@query(
    "check_versions",
    """select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as version
    from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type""",
)
def check_versions(d: Data) -> DataFrame:
    revisions = d.events.select("user_id", "ts", "event_id", "event_type")
    out = schemachecks.numbered_versions(revisions, "user_id", ["ts", "event_id"], ["event_type"], F.to_date("ts"))
    return out.select("user_id", "event_id", "event_type", "version")

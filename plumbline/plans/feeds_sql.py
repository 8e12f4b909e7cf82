"""The derivations of ``feeds`` as common table expressions for the SQL twins."""

from __future__ import annotations

AS_OF = "timestamp '2024-01-31 00:00:00'"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "feeds": ((), "select distinct user_id from events"),
    "slots": (
        (),
        """select user_id, started_at, cast(floor(date_diff('hour', timestamp '2024-01-01', started_at) / 8) as bigint) as slot,
        count(*) as row_count, max(ts) as latest, max(value) as max_value,
        count(*) filter (where value > 120) as v1, count(*) filter (where event_type = 'error') as v2,
        count(*) filter (where value < 2) as v3, count(*) filter (where length(props) < 9) as v4
        from (select *, time_bucket(interval '8 hours', ts, timestamp '2024-01-01') as started_at from events)
        group by user_id, started_at""",
    ),
    "datasets": (
        ("feeds",),
        """select user_id as dataset_id, 'feed_' || user_id as table_name, user_id % 5 as connection_id, 'conn_' || (user_id % 5) as connection_name,
        case user_id % 5 when 0 then '' when 1 then 'Commerce' when 2 then 'Growth' when 3 then 'Risk' else 'Ops' end as domain,
        case user_id % 3 when 0 then '' when 1 then 'Core' else 'Edge' end as team,
        case user_id % 4 when 0 then '' when 1 then 'ana' when 2 then 'bo' else 'cy' end as owner,
        case user_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as importance,
        case when user_id % 6 = 0 then cast(97.5 as double) end as slo_target_score, user_id % 9 <> 0 as slo_enabled, user_id % 17 = 0 as is_favorite
        from feeds""",
    ),
    "checks": (
        ("feeds",),
        """select user_id * 10 + n as check_id, user_id as dataset_id, 'feed ' || user_id || ' ' || check_type || ' ' || n as check_name,
        check_type, column_name, severity, tolerance,
        case when n = 2 and user_id % 13 = 0 then 'disabled' when n = 3 and user_id % 11 = 0 then 'archived'
             when n = 4 and user_id % 7 = 0 then 'proposed' else 'active' end as status
        from feeds, (values (1,'range','value','error',0),(2,'accepted_values','event_type','warn',0),(3,'range','value','info',0),
        (4,'string_length','props','error',1),(5,'row_count_min',null,'warn',0)) as k(n, check_type, column_name, severity, tolerance)""",
    ),
    "check_runs": (
        ("slots",),
        """select user_id * 10 + n as check_id, user_id as dataset_id, check_type, severity, (user_id * 10 + n) * 1000 + slot as run_id, started_at,
        case when n = 3 and max_value > 250 then null else row_count end as rows_evaluated,
        case when n = 3 and max_value > 250 then 0 else c end as violation_count,
        case when n = 3 and max_value > 250 then 'error' when c <= tolerance then 'pass' when severity in ('info','warn') then 'warn' else 'fail' end as status
        from (
          select *, 1 as n, 'range' as check_type, 'error' as severity, 0 as tolerance, v1 as c from slots
          union all select *, 2, 'accepted_values', 'warn', 0, v2 from slots
          union all select *, 3, 'range', 'info', 0, v3 from slots
          union all select *, 4, 'string_length', 'error', 1, v4 from slots
          union all select *, 5, 'row_count_min', 'warn', 0, cast(case when row_count < 2 then 1 else 0 end as bigint) from slots)""",
    ),
    "exceptions": (
        (),
        """select event_id as exception_id, user_id * 10 + 1 as check_id, user_id as dataset_id,
        (user_id * 10 + 1) * 1000 + cast(floor(date_diff('second', timestamp '2024-01-01', ts) / 28800) as bigint) as run_id,
        (user_id * 10 + 1) * 1000 + cast(floor(date_diff('second', timestamp '2024-01-01', ts) / 28800) as bigint) + event_id % 3 as last_run_id,
        sha256((user_id * 10 + 1) || '|' || event_id) as fingerprint, 'value out of range for user ' || user_id as reason,
        case when event_id % 7 = 0 then 'seen before' end as note,
        case event_id % 5 when 0 then 'open' when 1 then 'open' when 2 then 'acknowledged' when 3 then 'expected' else 'resolved' end as status,
        event_id % 3 + 1 as occurrence_count, nullif(event_id % 4, 0) as assigned_to_id, ts as first_seen_at,
        ts + to_hours(cast(event_id % 3 as int)) as last_seen_at,
        case when event_id % 5 = 4 or event_id % 6 = 0 then ts + interval '6 hours' end as marked_at, event_id % 2 + 1 as version
        from events where value > 120""",
    ),
    "rules": (
        ("feeds",),
        """select cast(1 as bigint) as rule_id, cast(null as bigint) as dataset_id, 'error' as min_severity, 'slack' as channel, true as enabled, true as on_error_runs,
        1440 as dedupe_window_minutes, 30 as escalation_delay_minutes, 2 as max_escalation_level
        union all select 2, null, 'warn', 'email', true, false, 2160, 0, 0
        union all select user_id + 100, user_id, 'info', 'webhook', user_id % 4 <> 0, false, case when user_id % 40 <> 0 then 960 end, 15, 1 from feeds where user_id % 10 = 0""",
    ),
    "users": (
        (),
        """select cast(a as bigint) as user_id, b as user_name, c as is_active, d as user_role
        from (values (1,'ana',true,'admin'),(2,'bo',false,'editor'),(3,'cy',true,'viewer'),(7,'di',true,'editor'),(8,'el',true,'viewer')) t(a,b,c,d)""",
    ),
    "grants": (
        (),
        "select cast(a as bigint) as user_id, cast(b as bigint) as connection_id, c as grant_role from (values (7,1,'viewer'),(7,2,'editor'),(8,2,'editor')) t(a,b,c)",
    ),
    "slas": (
        ("feeds",),
        """select user_id * 10 + 1 as sla_id, 'dataset' as scope, user_id as scope_id, 'check_success' as target_type, cast(0.9 as double) as objective, 7 as window_days from feeds
        union all select user_id * 10 + 2, 'check', user_id * 10 + 1, 'check_success', 0.95, 30 from feeds
        union all select user_id * 10 + 3, 'dataset', user_id, 'volume', 0.5, 30 from feeds where user_id % 2 = 0
        union all select user_id * 10 + 4, 'dataset', user_id, 'freshness', 0.99, 30 from feeds where user_id % 5 = 0
        union all select user_id * 10 + 5, 'check', user_id * 10 + 1, 'check_success', 1.0, 7 from feeds where user_id % 3 = 0""",
    ),
    "clauses": (
        ("checks",),
        """select dataset_id as contract_id, trim(regexp_replace(lower(check_name), '[^a-z0-9]+', '-', 'g'), '-') as clause_id, check_type, check_id
        from checks where status in ('active', 'proposed')""",
    ),
    "snapshot_columns": (
        (),
        """select user_id as dataset_id, day, name, dtype, nullable, date_diff('day', date '1970-01-01', day) as snapshot_id,
        row_number() over (partition by user_id, day order by f, fid) - 1 as ordinal
        from (select user_id, cast(ts as date) as day, event_type as name, min(ts) as f, arg_min(event_id, ts) as fid,
              case when max(value) >= 100 then 'bigint' else 'int' end as dtype, min(value) < 5 as nullable
              from events group by all)""",
    ),
    "latest": (
        ("check_runs",),
        """select check_id, started_at, run_id, status from check_runs
        qualify row_number() over (partition by check_id order by started_at desc, run_id desc) = 1""",
    ),
    "moves": (
        ("check_runs",),
        """select *, sum(case when kind = 'opened' then 1 else 0 end) over w as episode, sum(case when failing then 1 else 0 end) over w as occurrence_count
        from (select *, case when failing and not was then 'opened' when failing then 'occurred' when was then 'recovered' end as kind
              from (select *, coalesce(lag(failing) over (partition by check_id order by started_at, run_id), false) as was
                    from (select *, status in ('fail', 'error') as failing,
                          lag(status) over (partition by check_id order by started_at, run_id) as run_before from check_runs)
                    where status in ('pass', 'fail', 'error')))
        where kind is not null
        window w as (partition by check_id order by started_at, run_id)""",
    ),
    "incidents": (
        ("moves",),
        """select check_id, max(dataset_id) as dataset_id, arg_max(severity, run_id) as severity,
        case when arg_max(kind, run_id) = 'recovered' then 'resolved' else 'open' end as status,
        arg_max(status, run_id) filter (where kind <> 'recovered') as failure_status,
        min(started_at) as first_seen_at, max(started_at) as last_seen_at,
        case when arg_max(kind, run_id) = 'recovered' then max(started_at) end as resolved_at,
        max(run_id) as current_run_id, count(*) filter (where kind <> 'recovered') as occurrence_count,
        count(*) filter (where kind = 'opened' and episode > 1) as reopen_count
        from moves group by check_id""",
    ),
    "judged": (
        ("checks", "latest"),
        """select c.dataset_id, c.check_id, c.severity, coalesce(l.status, 'unknown') as s,
        case c.severity when 'info' then 0.5 when 'warn' then 1.0 else 2.0 end as w
        from checks c left join latest l using (check_id) where c.status = 'active'""",
    ),
    "scores": (
        ("judged", "datasets", "exceptions"),
        """select *, case when not slo_enabled then null else round(score - slo_target, 2) end as score_gap,
        case when not slo_enabled then 'disabled' when score is null then 'unknown' when round(score - slo_target, 2) >= 0 then 'met'
             when round(score - slo_target, 2) >= -2 then 'at_risk' else 'breached' end as slo_status
        from (select *, case when base_score is not null then round(greatest(0.0, least(100.0, base_score - exception_penalty)), 2) end as score
        from (select d.dataset_id, d.table_name, d.domain, d.team, d.owner, d.importance, d.slo_enabled,
          case d.importance when 'critical' then 4.0::double when 'high' then 3.0 when 'medium' then 2.0 else 1.0 end as importance_weight,
          round(p.points * 1000 / p.weight) / 100 as base_score,
          case when p.points is null then 0.0::double else least(30.0, coalesce(o.n, 0) * 2.0::double) end as exception_penalty,
          case when not d.slo_enabled then null else coalesce(d.slo_target_score,
            case d.importance when 'critical' then 98.0 when 'high' then 95.0 when 'medium' then 90.0 else 85.0 end) end as slo_target,
          coalesce(p.active_checks, 0) as active_checks, coalesce(p.passing, 0) as passing_checks, coalesce(p.warning, 0) as warning_checks,
          coalesce(p.failing, 0) as failing_checks, coalesce(p.errors, 0) as error_checks, coalesce(p.unknowns, 0) as unknown_checks,
          coalesce(o.n, 0) as open_exceptions
          from datasets d
          left join (select dataset_id, sum(w * 2)::double as weight,
              sum(w * 2 * case s when 'pass' then 10 when 'warn' then 7 when 'unknown' then 5 else 0 end)::double as points, count(*) as active_checks,
              count(*) filter (where s = 'pass') as passing, count(*) filter (where s = 'warn') as warning, count(*) filter (where s = 'fail') as failing,
              count(*) filter (where s = 'error') as errors, count(*) filter (where s = 'unknown') as unknowns
              from judged group by dataset_id) p using (dataset_id)
          left join (select dataset_id, count(*) as n from exceptions where status = 'open' group by 1) o using (dataset_id)))""",
    ),
}


def with_ctes(*names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the common table expressions it names, dependencies first."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{n} as ({CTES[n][1]})" for n in order)
    word = "with recursive" if recursive else "with"
    return f"{word} {parts}\n{body}"

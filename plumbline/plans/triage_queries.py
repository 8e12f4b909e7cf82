"""Exceptions, their state across runs, incidents, routing, and lineage graphs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import exceptions, incidents, insights, lineage, reconcile
from plumbline.operators.joins import distinct_rows
from plumbline.plans.feeds import AS_OF, Data, moment
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query
from plumbline.session import stored


@query(
    "exceptions_enriched",
    with_ctes("exceptions", "checks", body="""select exception_id, e.status, check_name, check_type, column_name, severity, occurrence_count from exceptions e
    join (select check_id, check_name, check_type, column_name, severity from checks) using (check_id)"""),
)
def exceptions_enriched(d: Data) -> DataFrame:
    joined = exceptions.with_checks(d.exceptions, d.checks)
    return joined.select("exception_id", "status", "check_name", "check_type", "column_name", "severity", "occurrence_count")


@query(
    "exceptions_display",
    with_ctes("exceptions", "checks", "datasets", "users", body="""select exception_id, c.check_name, c.severity, d.table_name, u.user_name || case when is_active then '' else ' (inactive)' end as assignee
    from exceptions e left join checks c using (check_id) left join datasets d on d.dataset_id = e.dataset_id left join users u on u.user_id = e.assigned_to_id"""),
)
def exceptions_display(d: Data) -> DataFrame:
    return exceptions.display(d.exceptions, d.checks, d.datasets, d.users).select("exception_id", "check_name", "severity", "table_name", "assignee")


@query(
    "exceptions_page",
    with_ctes("exceptions", "checks", body="""select exception_id, occurrence_count, severity from exceptions join (select check_id, severity from checks) using (check_id)
    order by occurrence_count desc, exception_id desc limit 50 offset 100"""),
)
def exceptions_page(d: Data) -> DataFrame:
    joined = exceptions.with_checks(d.exceptions, d.checks)
    return exceptions.page(joined, "occurrences", offset=100, limit=50).select("exception_id", "occurrence_count", "severity")


@query(
    "exceptions_page_seek",
    with_ctes("exceptions", "checks", body="""select exception_id, occurrence_count, severity from exceptions join (select check_id, severity from checks) using (check_id)
    order by occurrence_count desc, exception_id desc limit 50 offset 100"""),
)
def exceptions_page_seek(d: Data) -> DataFrame:
    """The third page, each page found from the last position of the one before."""
    joined = exceptions.with_checks(d.exceptions, d.checks)
    after = None
    for _ in range(2):
        last = exceptions.seek(joined, "occurrences", after, 50).agg(F.max("position").alias("p")).first()["p"]
        after = last if last is not None else after
    return exceptions.seek(joined, "occurrences", after, 50).select("exception_id", "occurrence_count", "severity")


@query(
    "view_counts",
    with_ctes("exceptions", "checks", body="""select count(*) filter (where e.status = 'open' and assigned_to_id = 1) as my_open, count(*) filter (where e.status = 'open' and first_seen_at >= timestamp '2024-01-30') as new_today,
    count(*) filter (where e.status = 'open' and severity = 'error') as high_severity, count(*) filter (where e.status = 'open' and occurrence_count >= 2) as recurring,
    count(*) filter (where e.status = 'open' and assigned_to_id is null) as unassigned, count(*) filter (where e.status = 'expected') as expected
    from exceptions e join (select check_id, severity from checks) using (check_id) where e.status in ('open', 'expected')"""),
)
def view_counts(d: Data) -> DataFrame:
    return exceptions.view_counts(exceptions.with_checks(d.exceptions, d.checks), 1, AS_OF)


FACET_BASE = "from exceptions e join (select check_id, severity, check_type from checks) c using (check_id) where occurrence_count >= 2"


@query(
    "exception_facets",
    with_ctes("exceptions", "checks", body=f"""select 'status' as facet, e.status as value, count(*) as n {FACET_BASE} and severity = 'error' and check_type = 'range' group by 2
    union all select 'severity', severity, count(*) {FACET_BASE} and e.status in ('open', 'resolved') and check_type = 'range' group by 2
    union all select 'check_type', check_type, count(*) {FACET_BASE} and e.status in ('open', 'resolved') and severity = 'error' group by 2
    union all select 'total', '', count(*) {FACET_BASE} and e.status in ('open', 'resolved') and severity = 'error' and check_type = 'range'
    union all select * from (select 'dataset', cast(dataset_id as varchar), count(*) as n {FACET_BASE} and e.status in ('open', 'resolved') and severity = 'error' and check_type = 'range' group by dataset_id order by n desc, dataset_id limit 20)"""),
)
def exception_facets(d: Data) -> DataFrame:
    joined = exceptions.with_checks(d.exceptions, d.checks)
    return exceptions.facets(joined, as_of=AS_OF, status=["open", "resolved"], severity=["error"], check_type="range", recurrence="recurring")


STATE_SQL = """, state as (select * from exceptions where first_seen_at < timestamp '2024-01-20'),
    raw as (select user_id * 10 + 1 as check_id, user_id as dataset_id, sha256((user_id * 10 + 1) || '|' || event_id) as fingerprint, event_id as position, 'seen again by user ' || user_id as reason, event_type from events
      where ts >= timestamp '2024-01-15' and value > 100),
    sight as (select check_id, fingerprint, min(dataset_id) as dataset_id, min(reason) as reason from raw group by 1, 2),
    m as (select coalesce(s.check_id, t.check_id) as check_id, coalesce(s.fingerprint, t.fingerprint) as fingerprint, coalesce(s.dataset_id, t.dataset_id) as dataset_id, s.check_id is not null as known, t.check_id is not null as seen,
      s.status, s.reason as sr, t.reason as tr, s.occurrence_count, s.version, s.first_seen_at, s.last_seen_at, s.run_id, s.last_run_id from state s full outer join sight t on s.check_id = t.check_id and s.fingerprint = t.fingerprint),
    next as (select check_id, fingerprint, dataset_id, case when known then run_id else 999 end as run_id, case when seen then 999 else last_run_id end as last_run_id, case when seen then tr else sr end as reason,
      case when not known or (seen and status = 'resolved') then 'open' else status end as status, case when known then first_seen_at else timestamp '2024-01-31' end as first_seen_at,
      case when seen then timestamp '2024-01-31' else last_seen_at end as last_seen_at, coalesce(occurrence_count, 0) + case when seen then 1 else 0 end as occurrence_count,
      case when not known then 1 else version + case when seen and status = 'resolved' then 1 else 0 end end as version,
      case when not seen then 'unseen' when not known then 'new' when status in ('expected', 'muted') then 'suppressed' when status = 'resolved' then 'regressed' else 'bumped' end as outcome from m)"""


def _reconciled(d: Data) -> DataFrame:
    state = d.exceptions.filter(F.col("first_seen_at") < moment(datetime(2024, 1, 20)))
    u, e = F.col("user_id"), F.col("event_id")
    check = u * 10 + 1
    seen = d.events.filter((F.col("ts") >= moment(datetime(2024, 1, 15))) & (F.col("value") > 100)).select(
        check.alias("check_id"),
        u.alias("dataset_id"),
        F.lit(999).cast("bigint").alias("run_id"),
        F.sha2(F.concat(check.cast("string"), F.lit("|"), e.cast("string")), 256).alias("fingerprint"),
        F.concat(F.lit("seen again by user "), u.cast("string")).alias("reason"),
        moment(AS_OF).alias("seen_at"),
        e.alias("position"),
    )
    # A third of the rows is sighted twice in the same run.
    twice = seen.unionByName(seen.filter(F.col("position") % 3 == 0).withColumn("position", F.col("position") + 1))
    return reconcile.reconcile(state, twice)


@query("reconcile_exceptions", with_ctes("exceptions", body=STATE_SQL + " select * from next"))
def reconcile_exceptions(d: Data) -> DataFrame:
    return _reconciled(d)


@query(
    "reconcile_events",
    with_ctes("exceptions", body=STATE_SQL + " select check_id, fingerprint, 'system' as kind, 'resolved' as from_status, 'open' as to_status, 'regressed: row reappeared after resolve' as comment from next where outcome = 'regressed'"),
)
def reconcile_events(d: Data) -> DataFrame:
    return reconcile.reconcile_events(_reconciled(d))


@query(
    "reconcile_counts",
    with_ctes("exceptions", body=STATE_SQL + """ select check_id, count(*) filter (where outcome = 'new') as new_count, count(*) filter (where outcome = 'suppressed') as suppressed_count,
    count(*) filter (where outcome = 'regressed') as regressed_count from next where outcome <> 'unseen' group by 1"""),
)
def reconcile_counts(d: Data) -> DataFrame:
    return reconcile.reconcile_counts(_reconciled(d))


@query(
    "auto_resolve",
    with_ctes("exceptions", "check_runs", body=""", passed as (select distinct check_id from check_runs where status = 'pass' and rows_evaluated is not null)
    select exception_id, check_id, case when e.status = 'open' and p.check_id is not null then 'resolved' else e.status end as status,
    version + case when e.status = 'open' and p.check_id is not null then 1 else 0 end as version, e.status = 'open' and p.check_id is not null as auto_resolved from exceptions e left join passed p using (check_id)"""),
)
def auto_resolve(d: Data) -> DataFrame:
    state = d.exceptions.select("exception_id", "check_id", "status", "version")
    return reconcile.auto_resolve(state, d.check_runs)


TRIAGE_SQL = """select exception_id, case when hit then 'acknowledged' else status end as status, case when hit then 3 else assigned_to_id end as assigned_to_id, case when hit then {now} else marked_at end as marked_at,
    version + case when hit then 1 else 0 end as version, hit and status <> 'acknowledged' as status_event, hit as assign_event, {refused} as refused
    from (select *, {hit} as hit from exceptions)"""


STALE = "(select count(*) > 0 from exceptions where exception_id % 100 = 1)"


def _triaged(d: Data, stale: bool) -> DataFrame:
    picked = d.exceptions.filter(F.col("exception_id") % 10 == 1)
    version = F.when(F.col("exception_id") % 100 == 1, F.col("version") + int(stale)).otherwise(F.col("version"))
    request = picked.select("exception_id", version.alias("expected_version"))
    state = d.exceptions.select("exception_id", "status", "assigned_to_id", "marked_at", "version")
    return reconcile.triage(state, request, reconcile.Triage(user_id=1, status="acknowledged", assign_to=3, note="looking"), moment(AS_OF))


@query("triage_apply", with_ctes("exceptions", body=TRIAGE_SQL.format(now="timestamp '2024-01-31'", hit="exception_id % 10 = 1", refused="false")))
def triage_apply(d: Data) -> DataFrame:
    return _triaged(d, stale=False)


@query("triage_conflict", with_ctes("exceptions", body=TRIAGE_SQL.format(now="timestamp '2024-01-31'", hit=f"(exception_id % 10 = 1 and not {STALE})", refused=STALE)))
def triage_conflict(d: Data) -> DataFrame:
    return _triaged(d, stale=True)


@query(
    "regressions",
    """select event_id, user_id, ts from (select *, lag(event_type = 'purchase') over (partition by user_id order by ts, event_id) as fixed from events) where fixed and event_type = 'error'""",
)
def regressions(d: Data) -> DataFrame:
    found = reconcile.regressions(
        d.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.to_date("ts"),
        bad=F.col("event_type") == "error", fixed=F.col("event_type") == "purchase",
    )
    return found.select("event_id", "user_id", "ts")


def events_of(d: Data) -> DataFrame:
    return incidents.incident_events(d.check_runs)


@query(
    "incident_events",
    with_ctes("moves", body="select check_id, run_id, started_at, status as run_status, kind, kind = 'opened' and episode > 1 as reopened, cast(episode as bigint) as episode, cast(occurrence_count as bigint) as occurrence_count from moves"),
)
def incident_events(d: Data) -> DataFrame:
    return events_of(d).select("check_id", "run_id", "started_at", "run_status", "kind", "reopened", "episode", "occurrence_count")


@query("incident_state", with_ctes("incidents", body="select * from incidents"))
def incident_state(d: Data) -> DataFrame:
    return incidents.incident_state(incidents.incident_moves(d.check_runs))


@query(
    "incident_episodes",
    with_ctes("moves", body="""select check_id, cast(episode as bigint) as episode, min(started_at) as opened_at, max(started_at) filter (where kind <> 'recovered') as last_failure_at,
    max(started_at) filter (where kind = 'recovered') as recovered_at, count(*) filter (where kind <> 'recovered') as failures from moves group by 1, 2"""),
)
def incident_episodes(d: Data) -> DataFrame:
    return incidents.incident_episodes(events_of(d))


@query(
    "incidents_page",
    with_ctes("incidents", body="select check_id, status, severity, last_seen_at, occurrence_count from incidents where status = 'open' and severity = 'error' order by last_seen_at desc, check_id desc limit 50"),
)
def incidents_page(d: Data) -> DataFrame:
    listed = incident_state(d).filter((F.col("status") == "open") & (F.col("severity") == "error"))
    return listed.orderBy(F.desc("last_seen_at"), F.desc("check_id")).limit(50).select("check_id", "status", "severity", "last_seen_at", "occurrence_count")


ROUTED = """, subjects as (select c.check_id, c.dataset_id, c.severity, l.status as run_status from checks c join latest l using (check_id) where c.status = 'active'),
    routed as (select s.*, r.rule_id, r.channel, r.dedupe_window_minutes, r.escalation_delay_minutes, r.max_escalation_level from subjects s join rules r on r.enabled and (r.dataset_id is null or r.dataset_id = s.dataset_id)
      and case r.min_severity when 'error' then 2 when 'warn' then 1 else 0 end <= case s.severity when 'error' then 2 when 'warn' then 1 else 0 end where s.run_status <> 'error' or r.on_error_runs)"""


def _routed(d: Data) -> DataFrame:
    latest = insights.last_per_key(d.check_runs.select("check_id", "started_at", "run_id", "status"), ["check_id"], ["started_at", "run_id"])
    subjects = d.checks.filter(F.col("status") == "active").select("check_id", "dataset_id", "severity").join(latest.select("check_id", F.col("status").alias("run_status")), "check_id")
    return incidents.eligible_rules(subjects, d.rules, ["check_id"])


@query(
    "incident_notifications",
    with_ctes("moves", "checks", "latest", "rules", recursive=True, body=ROUTED + """, windows as (select check_id, min(case coalesce(dedupe_window_minutes, 0) when 0 then 60 else dedupe_window_minutes end) as w from routed group by 1),
    cand as (select check_id, run_id, started_at, episode, kind, coalesce(w, 60) as w from moves left join windows using (check_id) where kind = 'opened' or (kind = 'occurred' and run_before = 'warn')),
    n as (select check_id, run_id, started_at, episode, w from cand where kind = 'opened'
      union all select c.check_id, c.run_id, c.started_at, c.episode, c.w from n join cand c on c.check_id = n.check_id and c.episode = n.episode and c.started_at >= n.started_at + to_minutes(n.w)
        and not exists (select 1 from cand x where x.check_id = n.check_id and x.episode = n.episode and x.started_at >= n.started_at + to_minutes(n.w) and x.started_at < c.started_at))
    select check_id, run_id, started_at, 'triggered' as action from n union all select check_id, run_id, started_at, 'recovered' from moves where kind = 'recovered'"""),
)
def incident_notifications(d: Data) -> DataFrame:
    """The window of a check is the shortest one of the rules that cover it."""
    return incidents.notifications(stored(events_of(d), "timeline"), incidents.dedupe_windows(_routed(d)))


@query("alert_routing", with_ctes("checks", "latest", "rules", body=ROUTED + " select check_id, dataset_id, severity, run_status, rule_id, channel from routed"))
def alert_routing(d: Data) -> DataFrame:
    return _routed(d).select("check_id", "dataset_id", "severity", "run_status", "rule_id", "channel")


@query(
    "escalations_due",
    with_ctes("checks", "latest", "rules", "incidents", body=ROUTED + """, open_i as (select *, cast(check_id % 20 // 10 as int) as escalation_level from incidents where status = 'open'),
    lim as (select i.check_id, max(coalesce(max_escalation_level, 0)) as max_level, min(case when coalesce(max_escalation_level, 0) > escalation_level and coalesce(escalation_delay_minutes, 0) > 0 then greatest(1, escalation_delay_minutes) end) as delay,
      min(case when coalesce(max_escalation_level, 0) > escalation_level + 1 and coalesce(escalation_delay_minutes, 0) > 0 then greatest(1, escalation_delay_minutes) end) as delay_after
      from open_i i join routed using (check_id) group by 1)
    select check_id, escalation_level + 1 as escalation_level, last_seen_at + to_minutes(delay) as due_at, timestamp '2024-01-30 20:00:00' + to_minutes(delay_after) as next_escalation_at, max_level from open_i join lim using (check_id)
    where last_seen_at + to_minutes(delay) <= timestamp '2024-01-30 20:00:00' and max_level > escalation_level"""),
)
def escalations_due(d: Data) -> DataFrame:
    opened = stored(incident_state(d).filter(F.col("status") == "open"), "incidents").withColumn("escalation_level", F.floor(F.col("check_id") % 20 / 10).cast("int"))
    levels = opened.select("check_id", "escalation_level")
    planned = incidents.next_escalations(opened, _routed(d).join(levels, "check_id"), "last_seen_at")
    due = incidents.escalations_due(planned, moment(datetime(2024, 1, 30, 20)))
    return due.select("check_id", "escalation_level", "due_at", "next_escalation_at", "max_level")


@query(
    "incident_actions",
    with_ctes("incidents", body="""select check_id, case when check_id % 3 = 1 and status = 'open' then 'resolved' when check_id % 3 = 0 and status = 'open' then 'acknowledged' else status end as status,
    case when check_id % 3 = 1 and status = 'open' then timestamp '2024-01-31' else resolved_at end as resolved_at, check_id % 3 < 2 and status = 'open' as acted from incidents"""),
)
def incident_actions(d: Data) -> DataFrame:
    """Users acknowledge a third of the incidents and, after an acknowledgement, resolve another third."""
    state = incident_state(d)
    at = F.when(F.col("check_id") % 3 == 1, moment(AS_OF)).otherwise(moment(datetime(2024, 1, 30)))
    said = state.select("check_id", F.when(F.col("check_id") % 3 == 1, "resolve").otherwise("acknowledge").alias("action"), at.alias("at")).filter(F.col("check_id") % 3 < 2)
    earlier = said.select("check_id", F.lit("acknowledge").alias("action"), moment(datetime(2024, 1, 29)).alias("at"))
    return incidents.apply_actions(state, said.unionByName(earlier)).select("check_id", "status", "resolved_at", "acted")


@query(
    "retire_incidents",
    with_ctes("incidents", "checks", body="""select i.check_id, case when c.status in ('archived', 'disabled') then 'resolved' else i.status end as status,
    case when c.status in ('archived', 'disabled') and i.status <> 'resolved' then timestamp '2024-01-31' else resolved_at end as resolved_at, c.status in ('archived', 'disabled') and i.status <> 'resolved' as retired
    from incidents i join checks c using (check_id)"""),
)
def retire_incidents(d: Data) -> DataFrame:
    return incidents.retire(incident_state(d), d.checks, moment(AS_OF)).select("check_id", "status", "resolved_at", "retired")


EDGES_SQL = """edges as (select distinct 'part:' || l_partkey as source, 'order:' || l_orderkey as target from lineitem union all select 'order:' || o_orderkey, 'customer:' || o_custkey from orders
    union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation)"""


def edges(d: Data) -> DataFrame:
    """What feeds what: parts into orders, orders into customers, customers into nations, nations into regions."""

    def arc(df: DataFrame, a: str, source: str, b: str, target: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{a}:"), F.col(source).cast("string")).alias("source"), F.concat(F.lit(f"{b}:"), F.col(target).cast("string")).alias("target"))

    lines = d.table("lineitem").select("l_partkey", "l_orderkey")
    return (
        arc(distinct_rows(lines, lines.count()), "part", "l_partkey", "order", "l_orderkey")
        .unionByName(arc(d.table("orders"), "order", "o_orderkey", "customer", "o_custkey"))
        .unionByName(arc(d.table("customer"), "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(arc(d.table("nation"), "nation", "n_nationkey", "region", "n_regionkey"))
    )


def _start(d: Data, node: str) -> DataFrame:
    return d.values([(node,)], "id string")


REACH = """with recursive {edges}, arcs as ({arcs}), w(id, depth) as (select '{start}', 0 union select target, depth + 1 from w join arcs on source = id where depth < {depth}),
    nodes as (select id, min(depth) as depth from w group by 1)"""
BOTH = "select * from edges union all select target, source from edges"


@query("lineage_subgraph", REACH.format(edges=EDGES_SQL, arcs=BOTH, start="part:1", depth=2) + " select id, depth from nodes")
def lineage_subgraph(d: Data) -> DataFrame:
    return lineage.subgraph(edges(d), _start(d, "part:1"), 2)[0]


@query(
    "lineage_subgraph_edges",
    REACH.format(edges=EDGES_SQL, arcs=BOTH, start="part:1", depth=2) + " select source, target from edges where source in (select id from nodes) and target in (select id from nodes)",
)
def lineage_subgraph_edges(d: Data) -> DataFrame:
    return lineage.subgraph(edges(d), _start(d, "part:1"), 2)[1]


@query("lineage_downstream", REACH.format(edges=EDGES_SQL, arcs="select * from edges", start="part:1", depth=9) + " select id, depth from nodes")
def lineage_downstream(d: Data) -> DataFrame:
    return lineage.downstream(edges(d), _start(d, "part:1"))


@query("lineage_upstream", REACH.format(edges=EDGES_SQL, arcs="select target as source, source as target from edges", start="customer:1", depth=9) + " select id, depth from nodes")
def lineage_upstream(d: Data) -> DataFrame:
    return lineage.upstream(edges(d), _start(d, "customer:1"))


COLUMN_SQL = """with recursive pairs as (select distinct l_suppkey as s, l_partkey as p from lineitem),
    edges as (select 'supplier_' || s || '.part_' || p as source, 'nation_' || s_nationkey || '.part_' || p as target from pairs join supplier on s_suppkey = s
      union select 'nation_' || s_nationkey || '.part_' || p, 'region_' || n_regionkey || '.part_' || p from pairs join supplier on s_suppkey = s join nation on n_nationkey = s_nationkey),
    arcs as (select * from edges union all select target, source from edges), w(id, depth) as (select min(target), 0 from edges union select target, depth + 1 from w join arcs on source = id where depth < 2),
    nodes as (select id, min(depth) as depth from w group by 1)"""


def column_edges(d: Data) -> DataFrame:
    """Parts of suppliers into those of their nations, and these into those of their regions. Keys are made distinct before they are written out as names."""
    lines = d.table("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p"))
    rows = lines.count()
    placed = distinct_rows(lines, rows).join(d.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(
        d.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey"
    )
    part = F.col("p").isNotNull()  # without a part neither end has a name: all such rows are one, kept among the first
    supplied = distinct_rows(placed.select(*[F.when(part, F.col(c)).alias(c) for c in ("s_suppkey", "s_nationkey")], "p"), rows)
    gathered = distinct_rows(placed.filter(part).select("s_nationkey", "n_regionkey", "p"), rows)
    name = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"), F.lit(".part_"), F.col("p").cast("string"))
    first = supplied.select(name("supplier", "s_suppkey").alias("source"), name("nation", "s_nationkey").alias("target"))
    second = gathered.select(name("nation", "s_nationkey").alias("source"), name("region", "n_regionkey").alias("target"))
    return first.unionByName(second)


@query("lineage_columns", COLUMN_SQL + " select substr(id, 1, length(id) - length(split_part(id, '.', -1)) - 1) as table_id, min(depth) as depth, count(*) as columns from nodes group by 1")
def lineage_columns(d: Data) -> DataFrame:
    arcs = stored(column_edges(d), "column-edges")
    return lineage.column_subgraph(arcs, arcs.agg(F.min("target").alias("id")), 2)[1]


@query(
    "lineage_resolve",
    """with cat as (select distinct lower(p_brand) as s, lower(p_type) as n, lower(p_brand) || '.' || lower(p_type) as node_id from part),
    refs as (select distinct case p_size % 3 when 0 then p_brand when 1 then 'Brand#X' end as ref_schema, p_type || case when p_size % 7 = 0 then ' x' else '' end as ref_name from part),
    lone as (select n, min(node_id) as node_id from cat group by 1 having count(*) = 1)
    select ref_schema, ref_name, coalesce(e.node_id, l.node_id, case when ref_schema is null then ref_name else ref_schema || '.' || ref_name end) as node_id,
    case when e.node_id is not null then 'exact' when l.node_id is not null then 'unique_name' else 'external' end as resolved_by
    from refs left join cat e on e.s = lower(ref_schema) and e.n = lower(ref_name) left join lone l on l.n = lower(ref_name)""",
)
def lineage_resolve(d: Data) -> DataFrame:
    part, size = d.table("part"), F.col("p_size")
    catalog = part.select(
        F.col("p_brand").alias("schema_name"), F.col("p_type").alias("table_name"), F.concat_ws(".", F.lower("p_brand"), F.lower("p_type")).alias("node_id")
    ).distinct()
    refs = part.select(
        F.when(size % 3 == 0, F.col("p_brand")).when(size % 3 == 1, "Brand#X").alias("ref_schema"),
        F.concat("p_type", F.when(size % 7 == 0, " x").otherwise("")).alias("ref_name"),
    ).distinct()
    return lineage.resolve_references(refs, catalog)


@query(
    "lineage_overlay",
    with_ctes("check_runs", "checks", "exceptions", "datasets", body=""", l as (select check_id, any_value(dataset_id) as dataset_id, arg_max(status, run_id) as s from check_runs group by 1),
    f as (select l.dataset_id, count(*) filter (where c.status = 'active' and l.s = 'fail') as fails from l left join checks c using (check_id) group by 1),
    o as (select dataset_id, count(*) as opens from exceptions where status = 'open' group by 1)
    select table_name as id, dataset_id, case when coalesce(fails, 0) > 0 then 'fail' when coalesce(opens, 0) > 0 then 'warn' when fails is not null then 'pass' else 'unknown' end as health,
    coalesce(fails, 0) as failing_checks, coalesce(opens, 0) as open_exceptions, owner, importance from datasets left join f using (dataset_id) left join o using (dataset_id)"""),
)
def lineage_overlay(d: Data) -> DataFrame:
    nodes = d.datasets.select(F.col("table_name").alias("id"), "dataset_id")
    health = insights.lineage_health(d.check_runs, d.checks, d.exceptions, d.datasets)
    return lineage.overlay(nodes, health, d.datasets.select("dataset_id", "owner", "importance"))

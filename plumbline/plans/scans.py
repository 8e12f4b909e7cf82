"""Sources, projections, filters and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import cells, fingerprint, text
from plumbline.operators import drift, exceptions, insights, schemachecks
from plumbline.operators.rowchecks import healthy_predicate
from plumbline.operators.spec import CheckSpec
from plumbline.plans.feeds import AS_OF, Data, moment
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query
from plumbline.session import run_folder
from plumbline.sources import readers, sinks, workbench


@query(
    "scan_union_files",
    """select region, count(*) as n, round(sum(balance), 2) as balance from (
    select r_name as region, c_acctbal as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    union all select r_name, s_acctbal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) group by region""",
)
def scan_union_files(d: Data) -> DataFrame:
    places = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    people = readers.scan_files(d.spark, [f"{d.folder}/customer.parquet"]).select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("balance"))
    firms = readers.scan_files(d.spark, [f"{d.folder}/supplier.parquet"]).select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("balance"))
    return people.unionByName(firms).join(places, "n_nationkey").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


CATALOG_TABLES = {
    "customer": [("c_custkey", "bigint", "numeric"), ("c_name", "string", "string"), ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "string")],
    "events": [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "temporal"), ("user_id", "bigint", "numeric"), ("event_type", "string", "string"), ("value", "double", "numeric"), ("props", "string", "string")],
    "embeddings": [("vec_id", "bigint", "numeric"), ("embedding", "array<float>", "other"), ("label", "int", "numeric")],
}


def _catalog_sql(tables: list[str], counted: bool = False) -> str:
    nulls = lambda name: f", count(*) - count({name}) as null_count" if counted else ""
    return " union ".join(
        f"select '{t}' as table_name, {i} as ordinal, '{name}' as name, '{dtype}' as dtype, '{kind}' as kind, true as nullable{nulls(name)} from {t}"
        for t in tables
        for i, (name, dtype, kind) in enumerate(CATALOG_TABLES[t])
    )


@query("column_catalog", _catalog_sql(["customer", "events", "embeddings"]))
def column_catalog(d: Data) -> DataFrame:
    return schemachecks.column_catalog({t: d.table(t) for t in ("customer", "events", "embeddings")})


@query("classify_columns", f"select kind, count(*) as columns, cast(sum(null_count) as bigint) as null_cells from ({_catalog_sql(['customer', 'events', 'embeddings'], True)}) group by kind")
def classify_columns(d: Data) -> DataFrame:
    nulls = schemachecks.null_counts({t: d.table(t) for t in ("customer", "events", "embeddings")})
    return column_catalog(d).join(nulls, ["table_name", "name"]).groupBy("kind").agg(F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("null_cells"))


@query(
    "workbench_select",
    "select c_mktsegment as segment, count(*) as n, round(avg(c_acctbal), 2) as avg_balance, false as truncated from customer where c_acctbal >= 1000 group by 1",
)
def workbench_select(d: Data) -> DataFrame:
    d.table("customer").createOrReplaceTempView("customer")
    body = "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 2) AS avg_balance FROM customer WHERE c_acctbal >= :least GROUP BY 1 ORDER BY 1"
    return workbench.run_select(d.spark, body, {"least": 1000})


@query(
    "panels_batch",
    """select cast(0 as int) as panel, 'Total rows' as title, '{"total_rows":' || count(*) || '}' as row, false as truncated, null::varchar as error from orders
    union all select 1, 'Orders by status', '{"value":"' || o_orderstatus || '","n":' || count(*) || '}', false, null from orders group by o_orderstatus
    union all select 2, 'Broken', null, null, 'AnalysisException: UNRESOLVED_COLUMN.WITH_SUGGESTION'
    union all select 3, 'Writes', null, null, 'ParseException: PARSE_SYNTAX_ERROR'
    union all select 4, 'Events per day', '{"day":"' || day || '","n":' || n || '}', false, null from (select cast(ts as date) as day, count(*) as n from events group by 1 order by 1 desc limit 45)""",
)
def panels_batch(d: Data) -> DataFrame:
    for t in ("orders", "events"):
        d.table(t).createOrReplaceTempView(t)
    panels = [
        workbench.Panel("Total rows", "SELECT count(*) AS total_rows FROM orders"),
        workbench.Panel("Orders by status", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1"),
        workbench.Panel("Broken", "SELECT no_such_column FROM events"),
        workbench.Panel("Writes", "DROP TABLE events"),
        workbench.Panel("Events per day", "SELECT to_date(ts) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 45"),
    ]
    return workbench.run_panels(d.spark, panels)


@query("preview_orders", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders order by o_orderkey limit 200")
def preview_orders(d: Data) -> DataFrame:
    rows = d.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return readers.preview(rows, ["o_orderkey"], 200)


@query(
    "csv_safe_cells",
    r"""with t as (select doc_id, case when n_chars % 3 = 0 then '=' || lang when n_chars % 3 = 1 then '-' || source else source end as raw from documents)
    select doc_id, case when regexp_matches(raw, '^[=+\-@\t\r]') then '''' || raw else raw end as safe from t""",
)
def csv_safe_cells(d: Data) -> DataFrame:
    turn = F.col("n_chars") % 3
    raw = F.when(turn == 0, F.concat(F.lit("="), "lang")).when(turn == 1, F.concat(F.lit("-"), "source")).otherwise(F.col("source"))
    return sinks.safe_csv_rows(d.table("documents").select("doc_id", raw.alias("safe")))


@query(
    "tsv_flatten",
    r"""with t as (select doc_id, regexp_replace(text, '[\t\r\n]+', ' ', 'g') as flat from documents)
    select cast(doc_id as varchar) as doc_id, case when regexp_matches(flat, '^[=+\-@\t\r]') then '''' || flat else flat end as text from t""",
)
def tsv_flatten(d: Data) -> DataFrame:
    return sinks.flat_rows(d.table("documents").select("doc_id", "text"))


@query(
    "snapshot_upsert",
    """with a as (select user_id, cast(ts as date) as day, count(*) as n, 'old' as origin from events where ts < timestamp '2024-01-20' group by 1, 2),
    b as (select user_id, cast(ts as date) as day, count(*) as n, 'new' as origin from events where ts >= timestamp '2024-01-15' group by 1, 2)
    select * from a where not exists (select 1 from b where b.user_id = a.user_id and b.day = a.day) union all select * from b""",
)
def snapshot_upsert(d: Data) -> DataFrame:
    def daily(rows: DataFrame, origin: str) -> DataFrame:
        return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(origin))

    old = daily(d.events.filter(F.col("ts") < moment(datetime(2024, 1, 20))), "old")
    new = daily(d.events.filter(F.col("ts") >= moment(datetime(2024, 1, 15))), "new")
    return sinks.merged(old, new, ["user_id", "day"])


@query(
    "snapshot_upsert_buckets",
    """with a as (select user_id, cast(ts as date) as day, count(*) as n, 'old' as origin from events where ts < timestamp '2024-01-20' group by 1, 2),
    b as (select user_id, cast(ts as date) as day, count(*) as n, 'new' as origin from events where ts >= timestamp '2024-01-15' group by 1, 2)
    select * from a where not exists (select 1 from b where b.user_id = a.user_id and b.day = a.day) union all select * from b""",
)
def snapshot_upsert_buckets(d: Data) -> DataFrame:
    """The same merge into a state table laid out by key bucket, in two runs."""
    path = f"{run_folder(d.spark, 'state')}/daily"
    for rows, origin in ((d.events.filter(F.col("ts") < moment(datetime(2024, 1, 20))), "old"), (d.events.filter(F.col("ts") >= moment(datetime(2024, 1, 15))), "new")):
        daily = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(origin))
        sinks.upsert_buckets(path, daily, ["user_id", "day"], 16)
    return d.spark.read.parquet(path).drop(sinks.BUCKET)


@query(
    "jsonable_cells",
    """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, case when value <= 1 then null else value end as value,
    to_json({'k': event_type, 'u': user_id}) as nested from events""",
)
def jsonable_cells(d: Data) -> DataFrame:
    value = F.when(F.col("value") <= 1, float("nan")).otherwise(F.col("value"))
    nested = F.struct(F.col("event_type").alias("k"), F.col("user_id").alias("u"))
    return cells.jsonable(d.events.select("event_id", "ts", value.alias("value"), nested.alias("nested")))


@query("truncate_documents", "select doc_id, case when length(text) > 200 then text[1:200] || '…' else text end as text from documents")
def truncate_documents(d: Data) -> DataFrame:
    return cells.truncate(d.table("documents").select("doc_id", "text"), 200)


@query(
    "bounded_sample",
    "select event_id, user_id, value from events where cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 8) as bigint) % 10 < 3",
)
def bounded_sample(d: Data) -> DataFrame:
    return drift.bounded_sample(d.events.select("event_id", "user_id", "value"), ["event_id"], 3, 10)


@query("reservoir_sample", "select event_id, value from events order by sha256(cast(event_id as varchar)), event_id limit 2000")
def reservoir_sample(d: Data) -> DataFrame:
    return drift.reservoir_sample(d.events, "value", ["event_id"], 2000)


@query(
    "exceptions_in_scope",
    with_ctes("exceptions", "checks", "datasets", "grants", body="""select exception_id, e.dataset_id, e.status from exceptions e join checks c using (check_id) join datasets d on d.dataset_id = e.dataset_id
    where e.status = 'open' and d.connection_id in (select connection_id from grants where user_id = 7)"""),
)
def exceptions_in_scope(d: Data) -> DataFrame:
    """The open exceptions of the datasets that a user with grants may see."""
    enriched = exceptions.with_checks(d.exceptions, d.checks)
    scope = insights.visible(d.datasets, d.grants, 7, "viewer")
    return exceptions.filter_exceptions(enriched, scope, as_of=AS_OF, status=["open"]).select("exception_id", "dataset_id", "status")


@query("healthy_rows_range", "select c_custkey, c_acctbal from customer where c_acctbal is null or (c_acctbal >= 0 and c_acctbal <= 9000)")
def healthy_rows_range(d: Data) -> DataFrame:
    spec = CheckSpec(1, "range", "c_acctbal", {"min": 0, "max": 9000})
    return d.table("customer").filter(healthy_predicate(spec)).select("c_custkey", "c_acctbal")


FILTER = {"as_of": AS_OF, "status": ["open", "acknowledged"], "severity": ["error"], "recurrence": "recurring", "assignee": "1", "seen_since": datetime(2024, 1, 3), "text": "USER 1"}


@query(
    "exceptions_filtered",
    with_ctes("exceptions", "checks", body="""select exception_id, check_id, e.dataset_id, e.status, occurrence_count from exceptions e join checks c using (check_id)
    where e.status in ('open', 'acknowledged') and severity in ('error') and occurrence_count >= 2 and assigned_to_id = 1
    and last_seen_at >= timestamp '2024-01-03' and (contains(lower(reason), 'user 1') or contains(lower(coalesce(note, '')), 'user 1') or contains(lower(check_name), 'user 1'))"""),
)
def exceptions_filtered(d: Data) -> DataFrame:
    enriched = exceptions.with_checks(d.exceptions, d.checks)
    return exceptions.filter_exceptions(enriched, **FILTER).select("exception_id", "check_id", "dataset_id", "status", "occurrence_count")


@query(
    "runs_filtered",
    with_ctes("check_runs", body="""select check_id, run_id, started_at, status, violation_count from check_runs
    where status = 'fail' and started_at >= timestamp '2024-01-24'"""),
)
def runs_filtered(d: Data) -> DataFrame:
    return exceptions.filter_runs(d.check_runs, AS_OF, status="fail", since="7d").select("check_id", "run_id", "started_at", "status", "violation_count")


@query(
    "runs_of_day",
    with_ctes("check_runs", body="""select check_id, run_id, started_at, status from check_runs
    where started_at >= timestamp '2024-01-10' and started_at < timestamp '2024-01-11'"""),
)
def runs_of_day(d: Data) -> DataFrame:
    return exceptions.filter_runs(d.check_runs, AS_OF, day=datetime(2024, 1, 10)).select("check_id", "run_id", "started_at", "status")


@query(
    "checks_filtered",
    with_ctes("checks", body="""select check_id, check_name, status from checks where status <> 'archived'
    and (contains(lower(check_name), 'prop') or contains(lower(coalesce(column_name, '')), 'prop'))"""),
)
def checks_filtered(d: Data) -> DataFrame:
    live = d.checks.filter(F.col("status") != "archived")
    return live.filter(text.contains(F.col("check_name"), "prop") | text.contains(F.col("column_name"), "prop")).select("check_id", "check_name", "status")


@query("log_prefix", "select event_id, event_type, ts from events where starts_with(lower(event_type), 'p') and ts >= timestamp '2024-01-25'")
def log_prefix(d: Data) -> DataFrame:
    hit = F.startswith(F.lower("event_type"), F.lit("p")) & (F.col("ts") >= moment(datetime(2024, 1, 25)))
    return d.events.filter(hit).select("event_id", "event_type", "ts")


@query("retention_events", "select event_id, user_id, ts from events where ts >= timestamp '2024-01-31' - interval '10 days'")
def retention_events(d: Data) -> DataFrame:
    return retain(d.events, "ts", 10, AS_OF).select("event_id", "user_id", "ts")


def retain(df: DataFrame, stamp: str, days: int, as_of: datetime) -> DataFrame:
    """Rows younger than ``days``; zero or less keeps all. A range on the stamp, so day partitions prune."""
    return df if days <= 0 else df.filter(F.col(stamp) >= moment(as_of - timedelta(days=days)))


@query("redact_customer", "select c_custkey, case when c_name is not null then '[REDACTED]' end as c_name, c_nationkey, case when c_acctbal is not null then '[REDACTED]' end as c_acctbal, c_mktsegment from customer")
def redact_customer(d: Data) -> DataFrame:
    return cells.redact(d.table("customer"), ["C_NAME", "c_acctbal"])


@query("redact_json", """select event_id, case when event_id % 2 = 0 then '{"k":"[REDACTED]"}' else '{"k":"' || cast(json_extract(props, '$.k') as varchar) || '"}' end as props from events""")
def redact_json(d: Data) -> DataFrame:
    even, odd = cells.redact_json(F.col("props"), ["K"]), cells.redact_json(F.col("props"), ["other"])
    return d.events.select("event_id", F.when(F.col("event_id") % 2 == 0, even).otherwise(odd).alias("props"))


@query("tag_filter", "select doc_id, lang, source from documents where list_contains([lang, source, case when n_chars > 1000 then 'long' else 'short' end], 'long')")
def tag_filter(d: Data) -> DataFrame:
    tags = F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    return d.table("documents").withColumn("tags", tags).filter(F.array_contains("tags", "long")).select("doc_id", "lang", "source")


@query(
    "datasets_sorted",
    with_ctes("datasets", "exceptions", body="""select dataset_id, table_name, is_favorite, coalesce(n, 0) as open_exceptions from datasets
    left join (select dataset_id, count(*) as n from exceptions where status = 'open' group by 1) using (dataset_id)
    where trim(lower(domain)) = '' and (contains(table_name, 'feed_1') or contains(owner, 'feed_1'))
    order by is_favorite desc, open_exceptions desc, dataset_id"""),
)
def datasets_sorted(d: Data) -> DataFrame:
    opened = d.exceptions.filter(F.col("status") == "open").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    listed = d.datasets.join(opened, "dataset_id", "left").withColumn("open_exceptions", F.coalesce("n", F.lit(0)).cast("bigint"))
    return insights.sort_datasets(listed, domain="", text="feed_1").select("dataset_id", "table_name", "is_favorite", "open_exceptions")


@query(
    "visible_datasets",
    with_ctes("datasets", "grants", body="""select 7 as viewer, dataset_id, connection_id from datasets where connection_id in (select connection_id from grants where user_id = 7)
    union all select 9, dataset_id, connection_id from datasets"""),
)
def visible_datasets(d: Data) -> DataFrame:
    cols = ["dataset_id", "connection_id"]
    granted = insights.visible(d.datasets, d.grants, 7, "editor").select(F.lit(7).alias("viewer"), *cols)
    ungranted = insights.visible(d.datasets, d.grants, 9, "viewer").select(F.lit(9).alias("viewer"), *cols)
    return granted.unionByName(ungranted)


@query(
    "effective_roles",
    with_ctes("datasets", "grants", "users", body="""select d.dataset_id, g.user_id,
    case when g.grant_role = 'viewer' or u.user_role = 'viewer' then 'viewer' when g.grant_role = 'editor' or u.user_role = 'editor' then 'editor' else 'admin' end as effective_role
    from grants g join users u using (user_id) join datasets d using (connection_id)"""),
)
def effective_roles(d: Data) -> DataFrame:
    roles = insights.effective_roles(d.grants, d.users)
    return d.datasets.join(roles, "connection_id").select("dataset_id", "user_id", "effective_role")


@query("slugify", "select distinct p_type, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugify(d: Data) -> DataFrame:
    label = F.concat_ws(" / ", "p_type", "p_name")
    return d.table("part").select("p_type", text.slug(label).alias("slug")).distinct()


@query(
    "duration_hours",
    """select l_orderkey % 97 as k, l_linenumber, count(*) as n, cast(max(case l_linenumber % 4 when 0 then (l_orderkey % 97)::double
    when 1 then (l_orderkey % 97) * 24.0 when 2 then (l_orderkey % 97) + 0.5 else null end) as double) as hours from lineitem group by 1, 2""",
)
def duration_hours(d: Data) -> DataFrame:
    k, turn = F.col("l_orderkey") % 97, F.col("l_linenumber") % 4
    raw = (
        F.when(turn == 0, F.concat(F.lit("pt"), k.cast("string"), F.lit("h")))
        .when(turn == 1, F.concat(F.lit(" P"), k.cast("string"), F.lit("D ")))
        .when(turn == 2, F.concat(k.cast("string"), F.lit(".5")))
        .otherwise(F.lit("soon"))
    )
    rows = d.table("lineitem").select(k.alias("k"), "l_linenumber", text.duration_hours(raw).alias("hours"))
    return rows.groupBy("k", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("hours").alias("hours"))


@query("json_props_range", "select cast(json_extract(props, '$.k') as int) as k, count(*) as n, round(sum(value), 2) as total from events where cast(json_extract(props, '$.k') as int) between 10 and 60 group by 1")
def json_props_range(d: Data) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = d.events.select(k.alias("k"), "value").filter(F.col("k").between(10, 60))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "exception_fingerprints",
    """select c_custkey, sha256('7|{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '","c_nationkey":"' || c_nationkey || '"}') as fingerprint
    from customer where c_acctbal < 0""",
)
def exception_fingerprints(d: Data) -> DataFrame:
    bad = d.table("customer").filter(F.col("c_acctbal") < 0)
    return bad.select("c_custkey", fingerprint.row_fingerprint(F.lit(7), ["c_custkey", "c_nationkey", "c_mktsegment"]).alias("fingerprint"))


@query(
    "schema_fingerprint",
    with_ctes("snapshot_columns", body="""select dataset_id, snapshot_id, sha256(string_agg(ordinal || ':' || name || ':' || dtype || ':' || nullable, ',' order by ordinal)) as fingerprint
    from snapshot_columns group by all"""),
)
def schema_fingerprint(d: Data) -> DataFrame:
    return d.snapshots.select("dataset_id", "snapshot_id", fingerprint.schema_fingerprint(F.col("columns")).alias("fingerprint"))


@query(
    "global_search",
    """select * from (select type, id, title, case when starts_with(lower(title), 'a') then 0 else 1 end as prefix_rank from (
    select * from (select 'region' as type, r_regionkey::bigint as id, r_name as title from region where contains(lower(r_name), 'a') order by title, id limit 5)
    union all select * from (select 'nation', n_nationkey::bigint, n_name from nation where contains(lower(n_name), 'a') order by n_name, n_nationkey limit 5)
    union all select * from (select 'part', p_partkey, p_name from part where contains(lower(p_name), 'a') order by p_name, p_partkey limit 5)
    union all select * from (select 'customer', c_custkey, c_name from customer where contains(lower(c_name), 'a') order by c_name, c_custkey limit 5)))""",
)
def global_search(d: Data) -> DataFrame:
    branches = {
        "region": (d.table("region"), F.col("r_regionkey"), F.col("r_name")),
        "nation": (d.table("nation"), F.col("n_nationkey"), F.col("n_name")),
        "part": (d.table("part"), F.col("p_partkey"), F.col("p_name")),
        "customer": (d.table("customer"), F.col("c_custkey"), F.col("c_name")),
    }
    return insights.global_search(branches, "a", 5)


@query("run_days", with_ctes("check_runs", body="select distinct cast(started_at as date) as day from check_runs"))
def run_days(d: Data) -> DataFrame:
    return d.check_runs.select(F.to_date("started_at").alias("day")).distinct()


CASCADE = """select 'checks' as table_name, count(*) as n from checks where dataset_id not in (select dataset_id from doomed)
 union all select 'check_runs', count(*) from check_runs where dataset_id not in (select dataset_id from doomed)
 union all select 'exceptions', count(*) from exceptions where dataset_id not in (select dataset_id from doomed)
   and run_id not in (select run_id from check_runs where dataset_id in (select dataset_id from doomed))
   and last_run_id not in (select run_id from check_runs where dataset_id in (select dataset_id from doomed))
 union all select 'slas', count(*) from slas where not (scope = 'dataset' and scope_id in (select dataset_id from doomed))
   and not (scope = 'check' and scope_id in (select check_id from checks where dataset_id in (select dataset_id from doomed)))"""


@query(
    "cascade_delete",
    with_ctes("checks", "check_runs", "exceptions", "slas", "datasets", body=f"select * from (with doomed as (select dataset_id from datasets where owner = 'bo') {CASCADE})"),
)
def cascade_delete(d: Data) -> DataFrame:
    tables = {"checks": d.checks, "check_runs": d.check_runs, "exceptions": d.exceptions, "slas": d.slas}
    left = insights.cascade_delete(tables, d.datasets.filter(F.col("owner") == "bo"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out

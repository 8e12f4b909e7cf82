"""Profiles, proposals, attribution, localisation and starter panels."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import FORMAT_PATTERNS
from plumbline.operators import contracts, joins, localize, profile, propose, suite
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.rowchecks import violation_predicate
from plumbline.operators.spec import CheckSpec
from plumbline.plans.feeds import Data
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query
from plumbline.session import stored

LINE_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


@query(
    "profile_basic",
    _union(
        [
            f"select '{c}' as column_name, '{t}' as dtype, count(*) as row_count, count(*) - count({c}) as null_count, round((count(*) - count({c})) / count(*), 6) as null_pct, "
            f"count(distinct {c}) as distinct_count, round(count(distinct {c}) / count(*), 6) as distinct_pct, "
            + (f"round(min({c}), 4)::double as min_number, round(max({c}), 4)::double as max_number" if t not in ("string", "timestamp_ntz") else "null as min_number, null as max_number")
            + " from lineitem"
            for c, t in LINE_COLUMNS.items()
        ]
    ),
)
def profile_basic(d: Data) -> DataFrame:
    df = d.table("lineitem")
    facts, distinct = profile.column_facts(df), profile.distinct_counts(profile.frequencies(df))
    joined = facts.join(distinct, "column_name", "left")
    return joined.select(
        "column_name", "dtype", "row_count", "null_count", "null_pct", "distinct_count", F.round(F.col("distinct_count") / F.col("row_count"), 6).alias("distinct_pct"),
        F.round(F.col("min_number") + 0.0, 4).alias("min_number"), F.round("max_number", 4).alias("max_number"),
    )


NUMERIC = [c for c, t in LINE_COLUMNS.items() if t not in ("string", "timestamp_ntz")]


@query(
    "profile_numeric",
    _union(
        [
            f"select '{c}' as column_name, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as stddev, "
            + ", ".join(f"round(quantile_cont({c}, {p}), 4)::double as p{int(p * 100):02d}" for p in profile.QUANTILES)
            + " from lineitem"
            for c in NUMERIC
        ]
    ),
)
def profile_numeric(d: Data) -> DataFrame:
    df = d.table("lineitem").select(*NUMERIC)
    names = [f"p{int(p * 100):02d}" for p in profile.QUANTILES]
    quant = exact_quantiles(df, NUMERIC, profile.QUANTILES)
    wide = quant.groupBy("column_name").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 4).alias(n) for p, n in zip(profile.QUANTILES, names, strict=True)])
    facts = profile.column_facts(df).select("column_name", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))
    return facts.join(wide, "column_name")


TOP_COLUMNS = {"customer": ["c_name", "c_nationkey", "c_mktsegment"]}


KEYED = "case when strlen(text) > 64 then 'sha256:' || sha256(text) else text end"


@query(
    "profile_top_values",
    _union(
        [
            f"select * from (select '{c}' as column_name, {c} as value, count(*) as n, cast(row_number() over (order by count(*) desc, {KEYED.replace('text', c)}) as int) as rank "
            f"from documents group by {c} qualify rank <= 10)"
            for c in ("lang", "source", "text")
        ]
    ),
)
def profile_top_values(d: Data) -> DataFrame:
    df = d.table("documents").select("lang", "source", "text")
    return profile.restore_long_values(df, profile.top_values(profile.frequencies(df))).select("column_name", "value", "n", "rank")


@query(
    "profile_sample_values",
    _union(
        [
            f"select * from (select '{c}' as column_name, cast({c} as varchar) as value, cast(row_number() over (order by cast({c} as varchar)) as int) as rank from customer group by {c} qualify rank <= 5)"
            for c in TOP_COLUMNS["customer"]
        ]
    ),
)
def profile_sample_values(d: Data) -> DataFrame:
    return profile.sample_values(profile.frequencies(d.table("customer"), TOP_COLUMNS["customer"])).select("column_name", "value", "rank")


def _pattern_sql(column: str, table: str) -> str:
    ratios = ", ".join(f"round(avg(case when regexp_matches({column}, '{p}') then 1 else 0 end), 4) as {name}" for name, p in FORMAT_PATTERNS.items())
    return f"select '{column}' as column_name, min(length({column})) as min_len, round(avg(length({column})), 2) as avg_len, max(length({column})) as max_len, {ratios} from {table}"


PAGES = """(select url, case page_id % 4 when 0 then '2024-01-0' || (page_id % 9 + 1) else '2023-11-15 08:30' end as seen, cast(page_id as varchar) as code,
    case page_id % 3 when 0 then 'user' || page_id || '@example.com' else 'nobody' end as contact from pages)"""


@query("profile_strings", _union([_pattern_sql(c, PAGES) for c in ("url", "seen", "code", "contact")]).replace("min(length", "cast(min(length").replace("max(length", "cast(max(length").replace(")) as min_len", ")) as int) as min_len").replace(")) as max_len", ")) as int) as max_len"))
def profile_strings(d: Data) -> DataFrame:
    facts = profile.column_facts(page_texts(d))
    return facts.select("column_name", "min_len", "avg_len", "max_len", *FORMAT_PATTERNS)


def page_texts(d: Data) -> DataFrame:
    p = F.col("page_id")
    return d.table("pages").select(
        "url",
        F.when(p % 4 == 0, F.concat(F.lit("2024-01-0"), (p % 9 + 1).cast("string"))).otherwise("2023-11-15 08:30").alias("seen"),
        p.cast("string").alias("code"),
        F.when(p % 3 == 0, F.concat(F.lit("user"), p.cast("string"), F.lit("@example.com"))).otherwise("nobody").alias("contact"),
    )


@query(
    "profile_temporal",
    f"""select 'seen' as column_name, 'string' as kind, max(cast(seen as timestamp)) as max_ts from {PAGES}
    union all select 'ts', 'temporal', max(ts) from events union all select 'l_shipdate', 'temporal', max(l_shipdate) from lineitem""",
)
def profile_temporal(d: Data) -> DataFrame:
    parts = [profile.column_facts(df) for df in (page_texts(d), d.events, d.table("lineitem"))]
    return profile.temporal_candidates(reduce(DataFrame.unionByName, parts))


@query(
    "profile_pk_candidates",
    _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, count(*) as row_count from {t} having count(*) >= 100 and count(*) = count({c}) and count(distinct {c}) = count(*)"
            for t, cols in (("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
            for c in cols
        ]
    ),
)
def profile_pk_candidates(d: Data) -> DataFrame:
    out = []
    for t in ("orders", "customer"):
        df = d.table(t)
        found = profile.key_candidates(profile.column_facts(df), profile.distinct_counts(profile.frequencies(df)))
        out.append(found.select(F.lit(t).alias("table_name"), "column_name", "row_count"))
    return reduce(DataFrame.unionByName, out)


@query("profile_full")
def profile_full(d: Data) -> DataFrame:
    return profile.profile(d.table("orders"))


@query("profile_approximate")
def profile_approximate(d: Data) -> DataFrame:
    df = d.table("lineitem")
    return profile.approximate_distinct(df).join(
        profile.approximate_quantiles(df, NUMERIC, [0.5]).select("column_name", F.col("q").alias("median")), "column_name", "left"
    )


PROPOSE = {
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")],
}


def _profile_rows() -> str:
    parts = []
    for t, cols in PROPOSE.items():
        for i, (c, kind) in enumerate(cols):
            num = kind == "numeric"
            parts.append(
                f"select '{t}' as t, '{c}' as c, {i} as i, '{kind}' as k, case typeof(min({c})) when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' else lower(typeof(min({c}))) end as dtype, "
                + (f"(select list(v order by m desc, v) from (select {c} as v, count(*) as m from {t} where {c} is not null group by 1 order by m desc, v limit 10))" if kind == "string" else "null::varchar[]") + " as top, "
                + f"count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as d, "
                + (f"min({c})::double as lo, max({c})::double as hi, stddev_samp({c})::double as sd, quantile_cont({c}, 0.99)::double as p99" if num else "null::double as lo, null::double as hi, null::double as sd, null::double as p99")
                + f" from {t}"
            )
    return _union(parts)


IDS, MEASURES = "(id|key|code|sku|uuid)", "(price|amount|total|qty|quantity|count|cost|fee)"

PROPOSE_SQL = f"""with p as (select *, n >= 100 and nulls = 0 and d = n as pk from ({_profile_rows()}))
 select t as table_name, 'not_null' as check_type, c as column_name, case when pk then 'error' else 'warn' end as severity, '{{}}' as params, null::double as lower, null::double as upper from p where n >= 100 and nulls = 0
 union all select t, 'unique', c, 'error', '{{}}', null, null from p where n >= 100 and d = n - nulls and nulls = 0 and (regexp_matches(c, '{IDS}') or pk)
 union all select t, 'range', c, 'error', null, 0, null from p where k = 'numeric' and hi > lo and lo >= 0 and regexp_matches(c, '{MEASURES}')
 union all select t, 'range', c, 'warn', null, lo - (hi - lo) * 0.5, hi + (hi - lo) * 0.5 from p where k = 'numeric' and hi > lo and not (lo >= 0 and regexp_matches(c, '{MEASURES}'))
 union all select t, 'range', c, 'warn', null, null, p99 * 20 from p where k = 'numeric' and p99 > 0 and hi > p99 * 20
 union all select t, 'accepted_values', c, 'warn', '{{"values":' || to_json(top) || '}}', null, null from p where k = 'string' and d > 0 and d <= 10 and n >= 500 and not regexp_matches(c, '{IDS}')
 union all select t, 'distribution_drift', c, 'info', '{{"method":"psi","threshold":0.2}}', null, null from p where k = 'string' and d > 0 and d <= 20 and n >= 500 and not regexp_matches(c, '{IDS}')
 union all select t, 'distribution_drift', c, 'info', '{{"method":"psi","threshold":0.2}}', null, null from (select *, row_number() over (partition by t order by sd desc, c desc) as r from p where k = 'numeric' and n >= 500 and sd > 0) where r <= 3
 union all select t, 'freshness', c, case when t = 'orders' then 'error' else 'warn' end, '{{"strategy":"adaptive","default_max_age_hours":' || case when t = 'orders' then 24 else 48 end || ',"min_history":3,"lookback_runs":14,"multiplier":2.0,"grace_hours":1.0}}', null, null
   from p where k = 'temporal' and regexp_matches(c, '(created|updated|date|time|_at|ts)')
 union all select t, 'schema_contract', null, 'warn', '{{"expected_columns":[' || string_agg('{{"name":"' || c || '","dtype":"' || dtype || '"}}', ',' order by i) || '],"allow_additive":true,"case_sensitive":false}}', null, null from p group by t
 union all select t, 'schema_change', null, 'warn', '{{"baseline":"previous"}}', null, null from p group by t
 union all select t, 'row_count_min', null, 'error', '{{"min_rows":' || greatest(1, max(n) // 2) || '}}', null, null from p group by t having max(n) >= 100
 union all select t, 'row_count_anomaly', null, 'warn', '{{"strategy":"adaptive"}}', null, null from p group by t having max(n) >= 100
 union all select t, 'ml_outlier', null, 'info', '{{"contamination":0.005' || coalesce(',"keys":' || to_json(list(c order by c) filter (where pk)), '') || '}}', null, null from p group by t having max(n) >= 500 and count(*) filter (where k = 'numeric') >= 2"""


def profiled_tables(d: Data) -> DataFrame:
    out = []
    for t in PROPOSE:
        df = d.table(t)
        freq = profile.frequencies(df)
        name = F.lit(t).alias("table_name")
        facts = profile.column_facts(df).select(name, "*")
        distinct = profile.distinct_counts(freq).select(name, "*")
        p99 = profile.numeric_quantiles(df, [0.99]).select(name, "column_name", F.col("q").alias("p99"))
        top = profile.restore_long_values(df, profile.top_values(freq)).groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("values"))
        out.append(propose.profiled(facts, distinct, p99, top.select(name, "*")))
    # One row per column, read by several rule sets: profile once.
    return stored(reduce(DataFrame.unionByName, out), "profile")


def _bounds(proposals: DataFrame) -> DataFrame:
    """A range's bounds as numbers in columns of their own, so that they compare as numbers."""
    is_range = F.col("check_type") == "range"
    bound = lambda name: F.round(F.get_json_object("params", f"$.{name}").cast("double"), 2)
    return proposals.withColumns({"lower": F.when(is_range, bound("min")), "upper": F.when(is_range, bound("max")), "params": F.when(~is_range, F.col("params"))})


def _knowledge(d: Data) -> DataFrame:
    return d.values([("orders", 24)], "table_name string, freshness_sla_hours int")


@query("propose_checks", f"select * replace (round(lower, 2) as lower, round(upper, 2) as upper) from ({PROPOSE_SQL})")
def propose_checks(d: Data) -> DataFrame:
    return _bounds(propose.propose_checks(profiled_tables(d), knowledge=_knowledge(d)))


@query(
    "propose_and_run",
    f"""with proposed as (select table_name, check_type, column_name from ({PROPOSE_SQL}) where check_type not in ('schema_change', 'row_count_anomaly', 'distribution_drift', 'ml_outlier'))
    select table_name, check_type, column_name, count(*) as checks, count(*) filter (where check_type = 'freshness') as stale from proposed group by 1, 2, 3""",
)
def propose_and_run(d: Data) -> DataFrame:
    """Every proposed check that needs no earlier run, built and run on the table it was proposed for: all but stale tables pass."""
    wanted = propose.propose_checks(profiled_tables(d), knowledge=_knowledge(d)).filter(~F.col("check_type").isin("schema_change", "row_count_anomaly", "distribution_drift", "ml_outlier"))
    out = []
    for table, checks in sorted(propose.specs(wanted).items()):
        out.append(suite.run_suite(d.table(table), checks, datetime(2010, 1, 1)).withColumn("table_name", F.lit(table)))
    rows = reduce(DataFrame.unionByName, out)
    return rows.groupBy("table_name", "check_type", "column_name").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") != "pass").alias("stale"))


@query(
    "propose_dedupe",
    f"""with all_proposals as ({PROPOSE_SQL}),
    existing as (select t as table_name, 'not_null' as check_type, c as column_name, case when i = 0 then 'archived' else 'active' end as status from ({_profile_rows()}) where k <> 'string')
    select table_name, check_type, column_name, min(severity) as severity, count(*) as proposed from all_proposals a
    where not exists (select 1 from existing e where e.status <> 'archived' and e.table_name = a.table_name and e.check_type = a.check_type and coalesce(e.column_name, '') = coalesce(a.column_name, ''))
    group by 1, 2, 3""",
)
def propose_dedupe(d: Data) -> DataFrame:
    columns = profiled_tables(d)
    existing = columns.filter(F.col("kind") != "string").select(
        "table_name", F.lit("not_null").alias("check_type"), "column_name", F.when(F.col("ordinal") == 0, "archived").otherwise("active").alias("status")
    )
    return propose.new_proposals(propose.propose_checks(columns, knowledge=_knowledge(d)), existing).select("table_name", "check_type", "column_name", "severity", "proposed")


@query(
    "propose_monitors",
    f"""with p as (select *, n >= 100 and nulls = 0 and d = n as pk from ({_profile_rows()})),
    drift as (select t, c, row_number() over (partition by t order by case when k = 'numeric' then 0 else 1 end, case when k = 'numeric' then -sd else d end, case when k = 'numeric' then '' else c end, c desc) as r from p
      where (k = 'numeric' and not pk and c not in ('id', 'key', 'code', 'sku', 'uuid') and sd > 0) or (k = 'string' and not regexp_matches(c, '{IDS}') and d > 1 and d <= 20))
    select t as table_name, 'freshness' as kind, 'freshness' as check_type, c as column_name, 'warn' as severity from p where k = 'temporal'
    union all select distinct t, 'volume', 'row_count_anomaly', null, 'warn' from p
    union all select distinct t, 'schema', 'schema_contract', null, 'warn' from p
    union all select t, 'drift', 'distribution_drift', c, 'info' from drift where r <= 4""",
)
def propose_monitors(d: Data) -> DataFrame:
    return propose.monitor_specs(profiled_tables(d))


@query(
    "default_contract",
    f"""select t as table_name, 'schema' as kind, c as column_name, nulls > 0 as nullable from ({_profile_rows()})
    union all select t, 'volume', null, null from ({_profile_rows()}) group by t having max(n) > 0""",
)
def default_contract(d: Data) -> DataFrame:
    return contracts.default_contract(profiled_tables(d)).select("table_name", "kind", "column_name", "nullable")


SPECS_SQL = """, desired as (select dataset_id, check_type || ':' || n as kind, severity from (select *, check_id % 10 as n from checks) where status in ('active', 'proposed')),
    managed as (select dataset_id, check_type || ':' || n as kind, check_id as spec_id, case when dataset_id % 8 = 0 then 'info' else severity end as severity, case when status = 'active' then 'active' else 'disabled' end as status
      from (select *, check_id % 10 as n from checks) where n <> 2
      union all select dataset_id, check_type || ':1', check_id + 1000000, severity, 'active' from checks where check_id % 10 = 1 and dataset_id % 12 = 0),
    m as (select *, row_number() over (partition by dataset_id, kind order by spec_id) as r from managed)
    select coalesce(d.dataset_id, m.dataset_id) as dataset_id, coalesce(d.kind, m.kind) as kind, m.spec_id,
    case when m.spec_id is null then 'create' when d.kind is null and m.status <> 'disabled' then 'disable' when d.kind is null then 'keep'
         when m.status = 'disabled' or d.severity <> m.severity then 'update' else 'keep' end as action
    from desired d full outer join (select * from m where r = 1) m on d.dataset_id = m.dataset_id and d.kind = m.kind
    union all select dataset_id, kind, spec_id, 'disable_duplicate' from m where r > 1 and status <> 'disabled'"""


@query("reconcile_specs", with_ctes("checks", body=SPECS_SQL))
def reconcile_specs(d: Data) -> DataFrame:
    n = F.col("check_id") % 10
    keyed = d.checks.withColumn("kind", F.concat_ws(":", "check_type", n.cast("string")))
    desired = keyed.filter(F.col("status").isin("active", "proposed")).select("dataset_id", "kind", "severity")
    managed = keyed.filter(n != 2).select(
        "dataset_id", "kind", F.col("check_id").alias("spec_id"),
        F.when(F.col("dataset_id") % 8 == 0, "info").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("status") == "active", "active").otherwise("disabled").alias("status"),
    )
    doubles = keyed.filter((n == 1) & (F.col("dataset_id") % 12 == 0)).select(
        "dataset_id", "kind", (F.col("check_id") + 1000000).alias("spec_id"), "severity", F.lit("active").alias("status")
    )
    return joins.reconcile_specs(desired, managed.unionByName(doubles), ["dataset_id", "kind"], ["severity"])


ATTRIBUTION = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "o_custkey": "cast(o_custkey as varchar)"}


@query(
    "attribution_factors",
    "with r as (select *, o_totalprice > 400000 as bad from orders), t as (select count(*) filter (where bad) as b, count(*) filter (where not bad) as g from r), "
    + "c as ("
    + _union([f"select '{c}' as column_name, {e} as value, count(*) filter (where bad) as fail_count, count(*) filter (where not bad) as healthy_count from r group by 2" for c, e in ATTRIBUTION.items()])
    + """) select column_name, value, fail_count, healthy_count, round(fail_count / b * 100, 2) as fail_pct, round(healthy_count / g * 100, 2) as healthy_pct,
    round(fail_count / b / (healthy_count / g + 1e-9), 2) as lift, round(fail_count / b * 0.6 + greatest(fail_count / b - healthy_count / g, 0.0) * 0.4, 6) as score
    from c, t where fail_count > 0 order by score desc, fail_pct desc, column_name, value limit 8""",
)
def attribution_factors(d: Data) -> DataFrame:
    spec = CheckSpec(1, "range", "o_totalprice", {"max": 400000})
    columns = [*ATTRIBUTION, "o_orderkey"]
    return localize.attribution_factors(d.table("orders"), violation_predicate(spec), columns, pii=["O_ORDERKEY"])


@query("localize_by_segment", "select event_type, count(*) as n from events where value > 150 group by 1 order by n desc, event_type limit 25")
def localize_by_segment(d: Data) -> DataFrame:
    df = d.events
    freq = profile.frequencies(df, ["event_type", "props"])
    segment = localize.best_segment(profile.column_facts(df), profile.distinct_counts(freq), exclude="value")
    return localize.by_segment(df, F.col("value") > 150, segment)


@query("localize_by_day", "select cast(ts as date) as day, count(*) as n from events where value > 150 group by 1 order by 1 desc limit 30")
def localize_by_day(d: Data) -> DataFrame:
    return localize.by_day(d.events, F.col("value") > 150, "ts")


@query("null_concentration", "select source, count(*) as n from documents left join labels using (doc_id) where quality is null group by 1 order by n desc, source limit 25")
def null_concentration(d: Data) -> DataFrame:
    docs = d.table("documents").select("doc_id", "source").join(d.table("labels").select("doc_id", "quality"), "doc_id", "left")
    return localize.by_segment(docs, F.col("quality").isNull(), "source")


@query("top_extremes", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 25")
def top_extremes(d: Data) -> DataFrame:
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return localize.extremes(rows, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("recent_rows", "select event_id, ts, user_id, event_type from events order by ts desc, event_id desc limit 50")
def recent_rows(d: Data) -> DataFrame:
    return d.events.select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("distinct_values", "select source as value, count(*) as n from documents group by 1 order by n desc, value limit 50")
def distinct_values(d: Data) -> DataFrame:
    return localize.distinct_values(d.table("documents"), "source")


@query("latest_per_day", "select cast(ts as date) as day, count(*) as n, max(ts) as latest from events group by 1 order by 1 desc limit 30")
def latest_per_day(d: Data) -> DataFrame:
    return localize.latest_per_day(d.events, "ts")


@query("panel_histogram", "select round(value / 16) * 16 as bucket, count(*) as n from events where value is not null group by 1 order by 1 limit 80")
def panel_histogram(d: Data) -> DataFrame:
    return localize.bucket_chart(d.events, "value", 16)


@query("panel_rows_per_day", "select cast(ts as date) as day, count(*) as n from events group by 1 order by 1 desc limit 45")
def panel_rows_per_day(d: Data) -> DataFrame:
    return localize.by_day(d.events, F.lit(True), "ts", 45)


@query("panel_rows_by_category", "select event_type as value, count(*) as n from events group by 1 order by n desc, 1 limit 12")
def panel_rows_by_category(d: Data) -> DataFrame:
    return localize.distinct_values(d.events, "event_type", 12)


@query("panel_missing", "select count(*) as null_rows from documents left join labels using (doc_id) where quality is null")
def panel_missing(d: Data) -> DataFrame:
    docs = d.table("documents").select("doc_id").join(d.table("labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.filter(F.col("quality").isNull()).agg(F.count(F.lit(1)).alias("null_rows"))

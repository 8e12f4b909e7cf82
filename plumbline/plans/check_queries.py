"""Checks: row level, table level, history, schema, drift, outliers, suites and cross-table rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import run_status
from plumbline.operators import drift, historychecks, outliers, rowchecks, schemachecks, suite, tablechecks
from plumbline.operators.profile import group_key
from plumbline.operators.spec import CheckSpec
from plumbline.plans.feeds import AS_OF, Data, moment
from plumbline.plans.feeds_sql import with_ctes
from plumbline.plans.registry import query
from plumbline.sources import workbench

STATUS = "case when violation_count <= {tol} then 'pass' when '{sev}' in ('info', 'warn') then 'warn' else 'fail' end"


def _row_sql(source: str, check_id: int, kind: str, column: str, predicate: str, severity: str = "error", tolerance: int = 0) -> str:
    return (
        f"select {check_id} as check_id, '{kind}' as check_type, '{column}' as column_name, rows_evaluated, violation_count, "
        f"{STATUS.format(tol=tolerance, sev=severity)} as status from (select count(*) as rows_evaluated, "
        f"count(*) filter (where {predicate}) as violation_count from {source})"
    )


LABELLED = "(select d.*, quality, toxic from documents d left join labels l using (doc_id))"


def labelled(d: Data) -> DataFrame:
    return d.table("documents").join(d.table("labels"), "doc_id", "left")


@query("check_not_null", _row_sql(LABELLED, 1, "not_null", "quality", "quality is null"))
def check_not_null(d: Data) -> DataFrame:
    return rowchecks.check_result(labelled(d).select("doc_id", "quality"), CheckSpec(1, "not_null", "quality"))


@query(
    "check_unique",
    """select count(*) as total_groups, cast(sum(c) as bigint) as rows_evaluated, count(*) filter (where c > 1) as duplicate_groups,
    cast(sum(c) filter (where c > 1) as bigint) as duplicated_rows, cast(sum(c - 1) filter (where c > 1) as bigint) as violation_count
    from (select text, count(*) as c from documents group by text)""",
)
def check_unique(d: Data) -> DataFrame:
    texts = d.table("documents").select(group_key(F.col("text")).alias("text"))
    groups = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("g")).select("g").scalar()
    return tablechecks.unique_counts(texts, "text").withColumn("total_groups", groups)


@query(
    "check_unique_samples",
    """select event_id, user_id, value from events where value in
    (select value from events group by value having count(*) > 1 order by count(*) desc, value limit 10)""",
)
def check_unique_samples(d: Data) -> DataFrame:
    return tablechecks.duplicate_samples(d.events.select("event_id", "user_id", "value"), "value", 10)


@query("check_accepted_values", _row_sql("events", 3, "accepted_values", "event_type", "event_type not in ('click', 'view', 'purchase', 'signup')", "warn", 66))
def check_accepted_values(d: Data) -> DataFrame:
    spec = CheckSpec(3, "accepted_values", "event_type", {"values": ["click", "view", "purchase", "signup"]}, "warn", 66)
    return rowchecks.check_result(d.events, spec)


@query("check_accepted_values_ci", _row_sql("customer", 4, "accepted_values", "c_mktsegment", "lower(c_mktsegment) not in ('building', 'household', 'machinery')"))
def check_accepted_values_ci(d: Data) -> DataFrame:
    spec = CheckSpec(4, "accepted_values", "c_mktsegment", {"values": ["Building", "household", "MACHINERY"], "case_sensitive": False})
    return rowchecks.check_result(d.table("customer"), spec)


@query("check_range", _row_sql("customer", 5, "range", "c_acctbal", "c_acctbal < 0"))
def check_range(d: Data) -> DataFrame:
    return rowchecks.check_result(d.table("customer"), CheckSpec(5, "range", "c_acctbal", {"min": 0}))


@query(
    "check_range_violations",
    """select c_custkey, c_acctbal, 'c_acctbal = ' || c_acctbal || ' outside [0, 9900]' as reason from customer
    where c_acctbal < 0 or c_acctbal > 9900 order by c_custkey limit 50""",
)
def check_range_violations(d: Data) -> DataFrame:
    spec = CheckSpec(5, "range", "c_acctbal", {"min": 0, "max": 9900})
    bad = rowchecks.violations(d.table("customer"), spec)
    return rowchecks.sample_violations(bad, ["c_custkey"], 50).select("c_custkey", "c_acctbal", "reason")


@query("check_string_length", _row_sql("documents", 6, "string_length", "text", "length(text) < 50 or length(text) > 5000", "info", 10))
def check_string_length(d: Data) -> DataFrame:
    return rowchecks.check_result(d.table("documents"), CheckSpec(6, "string_length", "text", {"min_len": 50, "max_len": 5000}, "info", 10))


@query("check_regex_match", _row_sql("pages", 7, "regex_match", "url", r"not regexp_matches(url, '^https://[a-z.]+/')"))
def check_regex_match(d: Data) -> DataFrame:
    return rowchecks.check_result(d.table("pages"), CheckSpec(7, "regex_match", "url", {"pattern": r"^https://[a-z.]+/"}))


EXPECTED = [("DOC_ID", "BIGINT", False), ("text", "string", False), ("quality", " Int ", False), ("toxic", "bigint", True), ("reviewed_by", "string", None)]


@query(
    "check_schema_contract",
    """with current as (select * from (values ('doc_id', 'bigint', true), ('text', 'string', true), ('lang', 'string', true), ('source', 'string', true), ('n_chars', 'bigint', true),
    ('quality', 'int', true), ('toxic', 'int', true)) t(name, dtype, nullable)),
    expected as (select * from (values ('DOC_ID','BIGINT',false),('text','string',false),('quality',' Int ',false),('toxic','bigint',true),('reviewed_by','string',null)) t(name, dtype, nullable)),
    j as (select e.name as en, c.name as cn, e.dtype as et, c.dtype as ct, e.nullable as eu, c.nullable as cu from expected e full outer join current c on lower(e.name) = lower(c.name))
    select en as column_name, 'missing' as change, et as expected, null as actual, true as violation from j where cn is null
    union all select cn, 'added', null, ct, false from j where en is null
    union all select en, 'type_changed', et, ct, true from j where lower(trim(et)) <> lower(trim(ct))
    union all select en, 'nullability_changed', cast(eu as varchar), cast(cu as varchar), true from j where eu <> cu""",
)
def check_schema_contract(d: Data) -> DataFrame:
    expected = d.values(EXPECTED, "name string, dtype string, nullable boolean")
    return schemachecks.contract_diff(expected, schemachecks.column_catalog({"documents": labelled(d)}))  # declared columns: no data is read


@query(
    "check_freshness",
    """select latest, future_rows, row_count, round(date_diff('second', latest, timestamp '2024-01-25') / 3600.0, 2)::double as age_hours, 0.001::double as max_age_hours,
    cast(case when latest is null or date_diff('second', latest, timestamp '2024-01-25') / 3600.0 > 0.001 then 1 else 0 end as bigint) as violation_count
    from (select max(ts) filter (where ts <= timestamp '2024-01-25') as latest, count(*) filter (where ts > timestamp '2024-01-25') as future_rows, count(*) as row_count
    from (select date_trunc('second', ts) as ts from events))""",
)
def check_freshness(d: Data) -> DataFrame:
    whole = d.events.select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return tablechecks.freshness(whole, "ts", datetime(2024, 1, 25), 0.001)


@query(
    "check_freshness_adaptive",
    with_ctes("slots", body="""select dataset_id, history_n, intervals_n, round(case when ok then greatest(0.0, med * 2.0 + 1.0) else 48.0 end, 6)::double as max_age_hours,
    case when ok then 'history' else 'default' end as threshold_source, round(age, 2)::double as age_hours,
    cast(case when age > (case when ok then greatest(0.0, med * 2.0 + 1.0) else 48.0 end) then 1 else 0 end as bigint) as violation_count
    from (select user_id as dataset_id, count(*) as history_n, cast(count(gap) as int) as intervals_n, quantile_cont(gap, 0.5) as med, date_diff('second', max(l), timestamp '2024-01-31') / 3600.0::double as age,
      count(*) >= 3 and count(gap) >= 2 as ok
    from (select user_id, l, case when l > lag(l) over w then date_diff('second', lag(l) over w, l) / 3600.0::double end as gap
      from (select user_id, started_at, date_trunc('second', latest) as l, row_number() over (partition by user_id order by started_at desc) as r from slots) where r <= 14
      window w as (partition by user_id order by r desc)) group by user_id)"""),
)
def check_freshness_adaptive(d: Data) -> DataFrame:
    runs = d.slots.select(F.col("user_id").alias("dataset_id"), "started_at", F.date_trunc("second", "latest").cast("timestamp_ntz").alias("latest"))
    learned = historychecks.adaptive_max_age(runs, "dataset_id", ["started_at"], "latest", 48.0, grace_hours=1.0)
    newest = runs.groupBy("dataset_id").agg(F.max("latest").alias("latest"))
    judged = tablechecks.freshness_of(newest.join(learned, "dataset_id"), moment(AS_OF), F.col("max_age_hours"))
    return judged.select(
        "dataset_id", "history_n", "intervals_n", F.round(learned["max_age_hours"], 6).alias("max_age_hours"), "threshold_source", "age_hours", "violation_count"
    )


@query(
    "check_row_count_min",
    "select count(*) as rows_evaluated, cast(case when count(*) < 20000 then 1 else 0 end as bigint) as violation_count from orders",
)
def check_row_count_min(d: Data) -> DataFrame:
    return tablechecks.row_count_min(d.table("orders"), 20000)


SIGMA = """select dataset_id, started_at, row_count, history_n, round(case when history_n >= 5 then m end, 4) as mean, round(case when history_n >= 5 then s end, 4) as std,
    round(case when history_n >= 5 then (row_count - m) / s end, 4) as z, cast(case when history_n >= 5 and abs((row_count - m) / s) > 3.0 then 1 else 0 end as bigint) as violation_count
    from (select user_id as dataset_id, started_at, row_count, count(*) over w as history_n, avg(row_count) over w as m,
    greatest(stddev_pop(row_count) over w, 1.0, avg(row_count) over w * 0.005) as s from slots
    window w as (partition by user_id order by started_at rows between 14 preceding and 1 preceding))"""


@query("check_volume_sigma", with_ctes("slots", body=SIGMA))
def check_volume_sigma(d: Data) -> DataFrame:
    runs = d.slots.select(F.col("user_id").alias("dataset_id"), "started_at", "row_count")
    out = historychecks.volume_sigma(runs, "dataset_id", ["started_at"], "row_count", F.to_date("started_at"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "z")})


ADAPTIVE = """select dataset_id, started_at, row_count, cast(history_n as int) as history_n, round(case when history_n >= 5 then c end, 4) as baseline_center,
    round(case when history_n >= 5 then greatest(0.0, c - 3.5 * s) end, 4) as lower_bound, round(case when history_n >= 5 then c + 3.5 * s end, 4) as upper_bound,
    round(case when history_n >= 5 then (row_count - c) / s end, 4) as score,
    cast(case when history_n >= 5 and (row_count < greatest(0.0, c - 3.5 * s) or row_count > c + 3.5 * s) then 1 else 0 end as bigint) as violation_count
    from (select *, greatest(mad * 1.4826, 1.0, abs(c) * 0.005) as s from (select dataset_id, started_at, row_count, len(past) as history_n, c,
      list_aggregate(list_transform(past, lambda x: abs(x - c)), 'median') as mad
      from (select *, cast(list_aggregate(past, 'median') as double) as c from (select user_id as dataset_id, started_at, row_count, coalesce(list(row_count::double) over w, []) as past from slots
      window w as (partition by user_id order by started_at rows between 14 preceding and 1 preceding)))))"""


@query("check_volume_adaptive", with_ctes("slots", body=ADAPTIVE))
def check_volume_adaptive(d: Data) -> DataFrame:
    runs = d.slots.select(F.col("user_id").alias("dataset_id"), "started_at", "row_count")
    out = historychecks.volume_adaptive(runs, "dataset_id", ["started_at"], "row_count", F.to_date("started_at"))
    return out.withColumns({c: F.round(c, 4) for c in ("baseline_center", "lower_bound", "upper_bound", "score")})


@query("check_custom_sql", "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity >= 45 and l_discount > 0.05")
def check_custom_sql(d: Data) -> DataFrame:
    spec = CheckSpec(
        9, "custom_sql", params={"sql": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM source WHERE l_quantity >= :q AND l_discount > :d", "args": {"q": 45, "d": 0.05}}
    )
    return workbench.sql_violations(d.table("lineitem"), spec)


@query("check_ml_outlier")
def check_ml_outlier(d: Data) -> DataFrame:
    rows = d.table("orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).alias("region_code"))
    return outliers.isolation_outliers(rows, ["o_orderkey"], contamination=0.005)


@query(
    "zscore_outliers",
    """select event_id, value, round((value - m) / s, 4) as z from events, (select avg(value) as m, stddev_samp(value) as s from events) where abs((value - m) / s) > 4""",
)
def zscore_outliers(d: Data) -> DataFrame:
    return outliers.zscore_outliers(d.events.select("event_id", "value"), "value").withColumn("z", F.round("z", 4))


MIDDLE = datetime(2024, 1, 16)

PSI_NUMERIC = """with base as (select value as x from events where ts < timestamp '2024-01-16'), cur as (select value + case when event_id % 3 = 0 and value <= 40 then 60 else 0 end as x from events where ts >= timestamp '2024-01-16'),
    q as (select quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as v from base),
    e as (select list_transform([v[2] + (v[3] - v[2]) * 0.25, v[2] + (v[3] - v[2]) * 0.75, v[3] + (v[4] - v[3]) * 0.2, v[3] + (v[4] - v[3]) * 0.6, v[4],
      v[4] + (v[5] - v[4]) * 0.4, v[4] + (v[5] - v[4]) * 0.8, v[5] + (v[6] - v[5]) * 0.25, v[5] + (v[6] - v[5]) * 0.75], lambda t: round(t, 9)) as edges from q),
    b as (select len(list_filter(edges, lambda t: t <= x)) as bin, count(*) as n from cur, e group by 1),
    s as (select g.bin, coalesce(n, 0)::double / (select count(*) from cur) as a, 0.1::double as x from (select unnest(range(0, 10)) as bin) g left join b using (bin))"""


@query(
    "check_drift_psi_numeric",
    PSI_NUMERIC
    + """ select round(sum((greatest(a, 0.0001) - x) * ln(greatest(a, 0.0001) / x)), 4) as score, count(*) as bins,
    cast(case when sum((greatest(a, 0.0001) - x) * ln(greatest(a, 0.0001) / x)) >= 0.2 then 1 else 0 end as bigint) as violation_count from s""",
)
def check_drift_psi_numeric(d: Data) -> DataFrame:
    return drift.psi_verdict(drift.psi_numeric(*_halves(d), "value"))


def _halves(d: Data) -> tuple[DataFrame, DataFrame]:
    """All events before and after a day; a third of the later ones is moved up where it is low."""
    late = F.col("ts") >= moment(MIDDLE)
    moved = F.col("value") + F.when((F.col("event_id") % 3 == 0) & (F.col("value") <= 40), 60).otherwise(0)
    return d.events.filter(~late), d.events.filter(late).withColumn("value", moved)


@query(
    "drift_psi_bins",
    PSI_NUMERIC + " select cast(bin as int) as bin, x as expected_share, round(a, 6) as actual_share, round((greatest(a, 0.0001) - x) * ln(greatest(a, 0.0001) / x), 6) as term from s",
)
def drift_psi_bins(d: Data) -> DataFrame:
    bins = drift.psi_numeric(*_halves(d), "value")
    return bins.select("bin", F.round("expected_share", 6).alias("expected_share"), F.round("actual_share", 6).alias("actual_share"), F.round("term", 6).alias("term"))


@query(
    "check_drift_psi_categorical",
    """with base as (select source as v from documents where doc_id % 2 = 0), cur as (select source as v from documents where doc_id % 2 = 1),
    top as (select v, count(*) as n from base group by v order by n desc, v limit 10),
    shares as (select top.v, n::double / (select count(*) from base) as e, (select count(*) from cur where cur.v = top.v)::double / (select count(*) from cur) as a from top),
    bins as (select * from shares union all select '__other__', greatest(0.0, 1.0 - sum(e)), greatest(0.0, 1.0 - sum(a)) from shares)
    select v as category, round(e, 6) as expected_share, round(a, 6) as actual_share,
    round((greatest(a, 0.0001) - greatest(e, 0.0001)) * ln(greatest(a, 0.0001) / greatest(e, 0.0001)), 6) as term from bins""",
)
def check_drift_psi_categorical(d: Data) -> DataFrame:
    docs = d.table("documents").select("doc_id", "source")
    even = F.col("doc_id") % 2 == 0
    bins = drift.psi_categorical(docs.filter(even), docs.filter(~even), "source")
    return bins.select("category", *[F.round(c, 6).alias(c) for c in ("expected_share", "actual_share", "term")])


KS = """with moved as (select ts, value + case when ts >= timestamp '2024-01-16' and event_id % 3 = 0 and value <= 40 then 60 else 0 end as value from events),
    v as (select value, count(*) filter (where ts >= timestamp '2024-01-16') as a, count(*) filter (where ts < timestamp '2024-01-16') as b from moved group by value),
    c as (select abs(sum(a) over (order by value) / (select sum(a) from v) - sum(b) over (order by value) / (select sum(b) from v)) as gap from v),
    d as (select max(gap) as statistic, cast((select sum(a) from v) as bigint) as n_current, cast((select sum(b) from v) as bigint) as n_prior from c)"""


@query("check_drift_ks", KS + " select round(statistic, 6) as statistic, n_current, n_prior from d")
def check_drift_ks(d: Data) -> DataFrame:
    before, after = _halves(d)
    return drift.ks_two_sample(after, before, "value").select(F.round("statistic", 6).alias("statistic"), "n_current", "n_prior")


@query(
    "drift_ks_verdict",
    KS + """, s as (select *, sqrt(n_current::double * n_prior / (n_current + n_prior)) * statistic as l from d),
    p as (select *, case when l < 0.2 then 1.0 else greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * l * l))))) end as p from s)
    select round(statistic, 6) as statistic, round(p::double, 6) as p_value, n_current, n_prior, case when p <= 0.2 then 1 else 0 end::bigint as violation_count from p""",
)
def drift_ks_verdict(d: Data) -> DataFrame:
    before, after = _halves(d)
    out = drift.ks_two_sample(after, before, "value")
    return out.withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})


def _prior_sql(now: int, before: int) -> str:
    """The verdict of one run against the sample of another."""
    return f"""select {now} as run_id, max(gap) as statistic, cast(sum(a) as bigint) as n_current, cast(sum(b) as bigint) as n_prior from (select a, b,
      abs(sum(a) over (order by value) / sum(a) over () - sum(b) over (order by value) / sum(b) over ()) as gap
      from (select value, sum(a) as a, sum(b) as b from (select value, 1 as a, 0 as b from s{now} union all select value, 0, 1 from s{before}) group by value))"""


@query(
    "drift_prior_runs",
    "with "
    + ", ".join(
        f"s{n} as (select value + case when {n} = 3 and event_id % 3 = 0 then 60 else 0 end as value from events where value is not null and ts >= timestamp '{a}' and ts < timestamp '{b}' order by sha256(cast(event_id as varchar)), event_id limit 2000)"
        for n, a, b in ((1, "2024-01-01", "2024-01-11"), (2, "2024-01-11", "2024-01-21"), (3, "2024-01-21", "2024-02-01"))
    )
    + f""" select 1::bigint as run_id, null::double as statistic, (select count(*) from s1) as n_current, 0::bigint as n_prior, 'baseline captured' as note
    union all select run_id, round(statistic, 6), n_current, n_prior, null from ({_prior_sql(2, 1)}) union all select run_id, round(statistic, 6), n_current, n_prior, null from ({_prior_sql(3, 1)})""",
)
def drift_prior_runs(d: Data) -> DataFrame:
    """Three runs, each against the sample that the newest run without an error left; the second one's result is an error."""
    samples, history = d.values([], drift.SAMPLES), d.values([], "check_id int, run_id bigint, status string")
    out = None
    for n, a, b in ((1, datetime(2024, 1, 1), datetime(2024, 1, 11)), (2, datetime(2024, 1, 11), datetime(2024, 1, 21)), (3, datetime(2024, 1, 21), datetime(2024, 2, 1))):
        moved = F.col("value") + F.when(F.lit(n == 3) & (F.col("event_id") % 3 == 0), 60).otherwise(0)
        rows = d.events.filter((F.col("ts") >= moment(a)) & (F.col("ts") < moment(b))).withColumn("value", moved)
        verdict, kept = drift.ks_against_prior(rows, "value", ["event_id"], 1, n, samples, history)
        samples = samples.unionByName(kept)
        history = history.unionByName(verdict.select("check_id", "run_id", F.when(F.col("run_id") == 2, "error").otherwise(F.col("status")).alias("status")))
        out = verdict if out is None else out.unionByName(verdict)
    return out.select("run_id", F.round("statistic", 6).alias("statistic"), "n_current", "n_prior", "note")


@query(
    "check_values_reference",
    """select 1 as check_id, 'accepted_values' as check_type, count(*) as rows_evaluated, count(*) filter (where l_partkey not in (select p_partkey from part where p_size < 40)) as violation_count from lineitem
    union all select 2, 'accepted_values', count(*), count(*) filter (where o_custkey > 1200 or o_custkey < 1) from orders""",
)
def check_values_reference(d: Data) -> DataFrame:
    """Accepted values out of a table, and a list that is too long for an expression."""
    small = d.table("part").filter(F.col("p_size") < 40).select("p_partkey")
    first = suite.run_suite(d.table("lineitem"), [CheckSpec(1, "accepted_values", "l_partkey", {"values_from": "part"})], given={1: small})
    second = suite.run_suite(d.table("orders"), [CheckSpec(2, "accepted_values", "o_custkey", {"values": list(range(1, 1201))})])
    return first.unionByName(second).select("check_id", "check_type", "rows_evaluated", "violation_count")


PAIRS = """pairs as (select dataset_id, day, lag(day) over (partition by dataset_id order by day) as before from (select distinct dataset_id, day from snapshot_columns)),
    cur as (select p.dataset_id, p.day, c.name, c.dtype, c.nullable, c.ordinal from pairs p join snapshot_columns c using (dataset_id, day) where before is not null),
    old as (select p.dataset_id, p.day, c.name, c.dtype, c.nullable, c.ordinal from pairs p join snapshot_columns c on c.dataset_id = p.dataset_id and c.day = p.before),
    j as (select coalesce(c.dataset_id, o.dataset_id) as dataset_id, coalesce(c.day, o.day) as day, c.name as cn, o.name as bn, c.dtype as ct, o.dtype as bt, c.nullable as cu, o.nullable as bu
      from cur c full outer join old o on c.dataset_id = o.dataset_id and c.day = o.day and c.name = o.name),
    orders2 as (select dataset_id, day, string_agg(name, ',' order by ordinal) as names, string_agg(name, ',' order by name) as sorted from cur group by all),
    orders1 as (select dataset_id, day, string_agg(name, ',' order by ordinal) as names, string_agg(name, ',' order by name) as sorted from old group by all)"""

CHANGES = """select dataset_id, day, 'removed' as change_type, bn as column_name, bt as from_value, null as to_value, true as alerting from j where cn is null
    union all select dataset_id, day, 'added', cn, null, ct, false from j where bn is null
    union all select dataset_id, day, 'type_changed', cn, bt, ct, true from j where ct <> bt
    union all select dataset_id, day, 'nullability_changed', cn, cast(bu as varchar), cast(cu as varchar), true from j where cu <> bu
    union all select a.dataset_id, a.day, 'reordered', null, null, null, false from orders2 a join orders1 b using (dataset_id, day) where a.sorted = b.sorted and a.names <> b.names"""


@query("check_schema_change", with_ctes("snapshot_columns", body=f", {PAIRS} {CHANGES}"))
def check_schema_change(d: Data) -> DataFrame:
    return schemachecks.schema_changes(d.snapshots, "dataset_id", ["day"], F.trunc("day", "month"))


@query(
    "check_schema_change_pinned",
    with_ctes("snapshot_columns", body=""", ends as (select dataset_id, max(snapshot_id) as last, max(snapshot_id) filter (where snapshot_id % 10 = 0) as base from snapshot_columns group by 1),
    cur as (select c.* from snapshot_columns c join ends e on e.dataset_id = c.dataset_id and e.last = c.snapshot_id where base is not null and name <> 'error'),
    old as (select c.* from snapshot_columns c join ends e on e.dataset_id = c.dataset_id and e.base = c.snapshot_id where name <> 'error')
    select coalesce(c.dataset_id, o.dataset_id) as dataset_id, case when o.name is null then 'added' when c.name is null then 'removed' else 'type_changed' end as change_type,
    coalesce(c.name, o.name) as column_name from cur c full outer join old o on c.dataset_id = o.dataset_id and c.name = o.name where c.name is null or o.name is null or c.dtype <> o.dtype"""),
)
def check_schema_change_pinned(d: Data) -> DataFrame:
    found = schemachecks.against_pinned(d.snapshots, "dataset_id", "snapshot_id", ignore=["error"])
    return found.filter(F.col("change_type").isin("added", "removed", "type_changed")).select("dataset_id", "change_type", "column_name")


@query(
    "check_status_mapping",
    with_ctes("check_runs", "checks", body="""select check_id, run_id, case when violation_count <= tolerance then 'pass' when c.severity in ('info', 'warn') then 'warn' else 'fail' end as status
    from check_runs r join (select check_id, severity, tolerance from checks) c using (check_id)"""),
)
def check_status_mapping(d: Data) -> DataFrame:
    joined = d.check_runs.select("check_id", "run_id", "violation_count").join(d.checks.select("check_id", "severity", "tolerance"), "check_id")
    return joined.select("check_id", "run_id", run_status(F.col("violation_count"), F.col("tolerance"), F.col("severity")).alias("status"))


LINE_SUITE = [
    CheckSpec(1, "not_null", "l_orderkey"),
    CheckSpec(2, "range", "l_quantity", {"min": 1, "max": 49}),
    CheckSpec(3, "range", "l_discount", {"min": 0, "max": 0.09}, "warn"),
    CheckSpec(4, "accepted_values", "l_returnflag", {"values": ["A", "N"]}, "warn"),
    CheckSpec(5, "accepted_values", "l_linestatus", {"values": ["o", "f"], "case_sensitive": False}),
    CheckSpec(6, "string_length", "l_returnflag", {"max_len": 1}),
    CheckSpec(7, "regex_match", "l_linestatus", {"pattern": "^[OF]$"}),
    CheckSpec(8, "row_count_min", params={"min_rows": 1000}),
    CheckSpec(9, "freshness", "l_shipdate", {"max_age_hours": 24}),
    CheckSpec(10, "range", "l_tax", {"max": 0.07}, "info", 100),
    CheckSpec(11, "range", "l_missing", {"min": 0}),
    CheckSpec(12, "unique", "l_extendedprice", severity="info"),
]

SUITE_AS_OF = datetime(2003, 1, 1)


def _suite_sql() -> str:
    rows = [
        (1, "not_null", "l_orderkey", "error", 0, "count(*) filter (where l_orderkey is null)"),
        (2, "range", "l_quantity", "error", 0, "count(*) filter (where l_quantity < 1 or l_quantity > 49)"),
        (3, "range", "l_discount", "warn", 0, "count(*) filter (where l_discount < 0 or l_discount > 0.09::double)"),
        (4, "accepted_values", "l_returnflag", "warn", 0, "count(*) filter (where l_returnflag not in ('A', 'N'))"),
        (5, "accepted_values", "l_linestatus", "error", 0, "count(*) filter (where lower(l_linestatus) not in ('o', 'f'))"),
        (6, "string_length", "l_returnflag", "error", 0, "count(*) filter (where length(l_returnflag) > 1)"),
        (7, "regex_match", "l_linestatus", "error", 0, "count(*) filter (where not regexp_matches(l_linestatus, '^[OF]$'))"),
        (8, "row_count_min", None, "error", 0, "case when count(*) < 1000 then 1 else 0 end"),
        (10, "range", "l_tax", "info", 100, "count(*) filter (where l_tax > 0.07::double)"),
        (12, "unique", "l_extendedprice", "info", 0, "count(l_extendedprice) - count(distinct l_extendedprice)"),
    ]
    parts = [
        f"select {i} as check_id, '{t}' as check_type, {repr(c) if c else 'null'} as column_name, '{s}' as severity, count(*) as rows_evaluated, "
        f"cast({m} as bigint) as violation_count, case when {m} <= {tol} then 'pass' when '{s}' in ('info', 'warn') then 'warn' else 'fail' end as status, null as detail from lineitem"
        for i, t, c, s, tol, m in rows
    ]
    stale = "max(l_shipdate) filter (where l_shipdate <= timestamp '2003-01-01') is null or date_diff('second', max(l_shipdate) filter (where l_shipdate <= timestamp '2003-01-01'), timestamp '2003-01-01') > 86400"
    parts.append(
        f"select 9, 'freshness', 'l_shipdate', 'error', null, cast(case when {stale} then 1 else 0 end as bigint), case when {stale} then 'fail' else 'pass' end, null from lineitem"
    )
    parts.append("select 11, 'range', 'l_missing', 'error', null, null, 'error', 'AnalysisException: UNRESOLVED_COLUMN.WITH_SUGGESTION' from (select count(*) from lineitem)")
    return " union all ".join(parts)


@query("suite_run", _suite_sql())
def suite_run(d: Data) -> DataFrame:
    return suite.run_suite(d.table("lineitem"), LINE_SUITE, SUITE_AS_OF)


EVERY_TYPE_SQL = """with n as (select count(*) as n, count(*) filter (where o_totalprice > 400000) as dear, count(*) - count(distinct o_custkey) as again,
    count(*) filter (where o_totalprice < 1000) as cheap from orders)
    select t.* from n, lateral (values
    (1, 'range', 'o_orderstatus', 'error', n, null, 'error', 'CAST_INVALID_INPUT: ' || n || ' cells'),
    (2, 'unique', 'nowhere', 'error', null, null, 'error', 'AnalysisException: UNRESOLVED_COLUMN.WITH_SUGGESTION'),
    (3, 'custom_sql', null, 'error', null, null, 'error', 'ParseException: PARSE_SYNTAX_ERROR'),
    (4, 'custom_sql', null, 'error', null, dear, case when dear > 0 then 'fail' else 'pass' end, null),
    (5, 'custom_sql', null, 'error', null, null, 'error', 'ArithmeticException: DIVIDE_BY_ZERO'),
    (6, 'schema_contract', null, 'error', null, 1, 'fail', null),
    (7, 'schema_change', null, 'warn', null, 1, 'warn', null),
    (8, 'distribution_drift', 'o_totalprice', 'error', null, 0, 'pass', null),
    (9, 'row_count_anomaly', null, 'error', n, 1, 'fail', null),
    (10, 'freshness', 'o_orderdate', 'error', null, 1, 'fail', null),
    (11, 'unique', 'o_custkey', 'error', n, again, case when again > 0 then 'fail' else 'pass' end, null),
    (12, 'row_count_anomaly', null, 'error', null, null, 'error', 'ValueError: no baseline or history was given'),
    (13, 'range', 'o_totalprice', 'info', n, cheap, case when cheap > 0 then 'warn' else 'pass' end, null)
    ) t(check_id, check_type, column_name, severity, rows_evaluated, violation_count, status, detail)"""


@query("suite_every_type", EVERY_TYPE_SQL)
def suite_every_type(d: Data) -> DataFrame:
    """All kinds of checks through one door, with those that cannot run as error rows."""
    orders = d.table("orders")
    specs = [
        CheckSpec(1, "range", "o_orderstatus", {"min": 0}),
        CheckSpec(2, "unique", "nowhere"),
        CheckSpec(3, "custom_sql", params={"sql": "SELECT o_orderkey FROM source WHERE ("}),
        CheckSpec(4, "custom_sql", params={"sql": "SELECT o_orderkey FROM source WHERE o_totalprice > :most", "args": {"most": 400000}}),
        CheckSpec(5, "custom_sql", params={"sql": "SELECT 1 / (o_orderkey - o_orderkey) AS x FROM source WHERE 1 / (o_orderkey - o_orderkey) > 0"}),
        CheckSpec(6, "schema_contract", params={"expected_columns": [("o_orderkey", "bigint", None), ("reviewed_by", "string", None)]}),
        CheckSpec(7, "schema_change", severity="warn"),
        CheckSpec(8, "distribution_drift", "o_totalprice", {"method": "ks"}),
        CheckSpec(9, "row_count_anomaly"),
        CheckSpec(10, "freshness", "o_orderdate", {"strategy": "adaptive"}),
        CheckSpec(11, "unique", "o_custkey"),
        CheckSpec(12, "row_count_anomaly"),
        CheckSpec(13, "range", "o_totalprice", {"min": 1000}, severity="info"),
    ]
    given = {
        7: d.values([("o_orderkey", "bigint", True), ("gone", "string", True)], "name string, dtype string, nullable boolean"),
        8: orders.filter(F.col("o_orderkey") % 2 == 0),
        9: d.values([(i, 100 + i % 2) for i in range(10)], "run_id bigint, rows_evaluated bigint"),
        10: d.values([(i, datetime(2024, 1, 1 + i)) for i in range(6)], "run_id bigint, latest timestamp_ntz"),
    }
    return suite.run_suite(orders, specs, datetime(2024, 2, 1), given=given)


@query(
    "suite_history",
    " union all ".join(
        f"select cast(ts as date) as day, {i} as check_id, '{t}' as check_type, '{c}' as column_name, '{s}' as severity, count(*) as rows_evaluated, count(*) filter (where {p}) as violation_count, "
        f"case when count(*) filter (where {p}) <= {tol} then 'pass' when '{s}' in ('info', 'warn') then 'warn' else 'fail' end as status, null as detail from events group by 1"
        for i, t, c, s, tol, p in (
            (1, "range", "value", "error", 0, "value > 300"),
            (2, "accepted_values", "event_type", "warn", 66, "event_type not in ('click', 'view', 'purchase', 'signup')"),
            (3, "range", "value", "error", 0, "value < 0.02"),
            (4, "string_length", "props", "info", 35, "length(props) < 9"),
        )
    ),
)
def suite_history(d: Data) -> DataFrame:
    specs = [
        CheckSpec(1, "range", "value", {"max": 300}),
        CheckSpec(2, "accepted_values", "event_type", {"values": ["click", "view", "purchase", "signup"]}, "warn", 66),
        CheckSpec(3, "range", "value", {"min": 0.02}),
        CheckSpec(4, "string_length", "props", {"min_len": 9}, "info", 35),
    ]
    return suite.run_suite(d.events, specs, by=[F.to_date("ts").alias("day")])


@query(
    "rule_order_totals",
    """select o_orderkey, round(o_totalprice, 4) as o_totalprice, round(s, 4) as lines_total, round(o_totalprice - s, 4) as difference from orders
    join (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(o_totalprice - s) > 0.01""",
)
def rule_order_totals(d: Data) -> DataFrame:
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    bad = tablechecks.order_totals_mismatch(d.table("orders"), d.table("lineitem"), "o_orderkey", "l_orderkey", "o_totalprice", amount)
    return bad.select("o_orderkey", *[F.round(c, 4).alias(c) for c in ("o_totalprice", "lines_total", "difference")])


@query("rule_orphans", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def rule_orphans(d: Data) -> DataFrame:
    return tablechecks.orphans(d.table("orders").select("o_orderkey", "o_custkey"), d.table("lineitem"), {"o_orderkey": "l_orderkey"})


@query(
    "rule_date_order",
    "select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate",
)
def rule_date_order(d: Data) -> DataFrame:
    lines = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return tablechecks.dates_out_of_order(lines, d.table("orders"), "l_orderkey", "o_orderkey", "l_shipdate", "o_orderdate")


@query(
    "view_order_revenue",
    """select o_orderkey, o_orderdate, o_orderstatus, o_totalprice, round(items_total, 2) as items_total, coalesce(item_count, 0) as item_count from orders
    left join (select l_orderkey, sum(l_extendedprice) as items_total, count(*) as item_count from lineitem group by 1) on l_orderkey = o_orderkey""",
)
def view_order_revenue(d: Data) -> DataFrame:
    return order_revenue(d).withColumn("items_total", F.round("items_total", 2))


def order_revenue(d: Data) -> DataFrame:
    """Orders with their line totals; lines are summed per order before the join."""
    lines = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("items_total"), F.count(F.lit(1)).alias("item_count"))
    heads = d.table("orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return heads.join(lines, "o_orderkey", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


@query(
    "view_daily_revenue",
    """select cast(o_orderdate as date) as day, count(*) as orders, round(sum(o_totalprice), 2) as revenue, round(sum(items_total), 2) as items_revenue from orders
    left join (select l_orderkey, sum(l_extendedprice) as items_total from lineitem group by 1) on l_orderkey = o_orderkey group by 1""",
)
def view_daily_revenue(d: Data) -> DataFrame:
    return order_revenue(d).groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.sum("items_total"), 2).alias("items_revenue")
    )


@query(
    "view_customer_value",
    """with settled as (select o_custkey, sum(l_extendedprice) as settled_amount, count(*) as payments from orders join lineitem on l_orderkey = o_orderkey and l_linestatus = 'F' group by 1)
    select c_custkey, c_name, c_mktsegment, round(settled_amount, 2) as settled_amount, payments from customer left join settled on o_custkey = c_custkey""",
)
def view_customer_value(d: Data) -> DataFrame:
    paid = d.table("lineitem").filter(F.col("l_linestatus") == "F").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    settled = d.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(paid, "o_orderkey").groupBy("c_custkey").agg(
        F.round(F.sum("amount"), 2).alias("settled_amount"), F.sum("n").alias("payments")
    )
    return d.table("customer").select("c_custkey", "c_name", "c_mktsegment").join(settled, "c_custkey", "left")

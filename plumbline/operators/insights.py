"""Dashboards over run and exception history: matrix, trends, KPIs, work queue, status page, search."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import HEALTH_RANK, ROLE_RANK, SEVERITY_RANK, STATUS_RANK, lookup, worst_status
from plumbline.operators.exceptions import at
from plumbline.operators.joins import last_per_key


def day_grid(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Each row of ``df`` once per day of the window that ends on the day of ``as_of``."""
    last = F.lit(as_of.date())
    return df.withColumn("day", F.explode(F.sequence(F.date_sub(last, days - 1), last)))


def check_matrix(checks: DataFrame, runs: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Worst status and run count per check and day; a day without a run has a NULL status."""
    first = at(datetime.combine(as_of.date() - timedelta(days=days - 1), datetime.min.time()))
    cells = runs.filter(F.col("started_at") >= first).groupBy("check_id", F.to_date("started_at").alias("day")).agg(
        F.max(lookup(F.col("status"), STATUS_RANK)).alias("_rank"), F.count(F.lit(1)).alias("runs")
    )
    grid = day_grid(checks.select("check_id", "severity"), as_of, days)
    return grid.join(cells, ["check_id", "day"], "left").select(
        "check_id", "severity", "day", worst_status(F.col("_rank")).alias("status"), F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs")
    )


def exception_series(exceptions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """New exceptions per day with the empty days filled in."""
    counts = exceptions.groupBy(F.to_date("first_seen_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = day_grid(exceptions.sparkSession.range(1).select(), as_of, days)
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def status_trend(runs: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    counts = runs.groupBy(F.to_date("started_at").alias("day")).agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"), ("error", "errored"))]
    )
    calendar = day_grid(runs.sparkSession.range(1).select(), as_of, days)
    names = ["passed", "warned", "failed", "errored"]
    return calendar.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def run_kpis(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Runs in the last day and the pass rate of the last week, in one pass over that week."""
    day, week = at(as_of - timedelta(hours=24)), at(as_of - timedelta(days=7))
    recent = F.col("started_at") >= week
    total = F.count_if(recent)
    return runs.filter(recent).agg(
        F.count_if(F.col("started_at") >= day).alias("runs_24h"),
        F.round(F.count_if(recent & (F.col("status") == "pass")) / F.nullif(total, F.lit(0)), 4).alias("pass_rate_7d"),
    )


def kpi_summary(checks: DataFrame, runs: DataFrame, exceptions: DataFrame, latest: DataFrame, as_of: datetime) -> DataFrame:
    """The dashboard's headline numbers as ``(metric, value)`` rows."""
    failing = latest.filter(F.col("status").isin("fail", "error")).select("check_id").withColumn("_bad", F.lit(True))
    check_part = checks.join(failing, "check_id", "left").agg(
        F.count_distinct("dataset_id").alias("datasets"),
        F.count_if(F.col("status") == "active").alias("active_checks"),
        F.count_if(F.col("status") == "proposed").alias("proposed_checks"),
        F.count_if((F.col("status") == "active") & F.col("_bad").isNotNull()).alias("failing_checks"),
    )
    open_part = exceptions.agg(F.count_if(F.col("status") == "open").alias("open_exceptions"))
    out = None
    for part in (check_part, run_kpis(runs, as_of), open_part):
        wide = part.select(*[F.col(c).cast("double").alias(c) for c in part.columns])
        long = wide.unpivot([], list(wide.columns), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def console_counts(exceptions: DataFrame, user_id: int, as_of: datetime) -> DataFrame:
    """The work queue's counters from one conditional aggregate."""
    c, day = F.col, at(as_of - timedelta(hours=24))
    is_open = c("status") == "open"
    true = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return exceptions.agg(
        true(c("first_seen_at") >= day).alias("new_exceptions_24h"),
        true((c("status") == "resolved") & (c("marked_at") >= day)).alias("resolved_24h"),
        true(is_open & (c("occurrence_count") > 1) & c("marked_at").isNotNull()).alias("regressed_open"),
        true(is_open & (c("assigned_to_id") == user_id)).alias("assigned_to_me_open"),
        true(is_open).alias("open_total"),
    )


def dataset_movers(exceptions: DataFrame, as_of: datetime, k: int = 5) -> DataFrame:
    """Datasets with the most new exceptions in the last day; one aggregate gives all three counts."""
    day, c = at(as_of - timedelta(hours=24)), F.col
    counts = exceptions.groupBy("dataset_id").agg(
        F.count_if(c("first_seen_at") >= day).alias("opened_24h"),
        F.count_if(F.coalesce((c("status") == "resolved") & (c("marked_at") >= day), F.lit(False))).alias("resolved_24h"),
        F.count_if(c("status") == "open").alias("open_total"),
    )
    return counts.filter(c("opened_24h") > 0).orderBy(F.desc("opened_24h"), F.asc("dataset_id")).limit(k)


def incident_activity(opened: DataFrame, stamp: str, as_of: datetime, days: int = 90) -> DataFrame:
    """Incidents first seen per day."""
    since = at(as_of - timedelta(days=days))
    return opened.filter(F.col(stamp) >= since).groupBy(F.to_date(stamp).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def heat_map(activity: DataFrame, as_of: datetime, days: int = 91) -> DataFrame:
    """Every day of the window with its heat bucket 0, 1, 2, 3 (3 to 4) or 4 (5 and more)."""
    calendar = day_grid(activity.sparkSession.range(1).select(), as_of, days)
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    heat = F.when(n <= 2, n).when(n <= 4, 3).otherwise(4).cast("int")
    return calendar.join(activity, "day", "left").select("day", n.alias("n"), heat.alias("heat"))


def failing_now(checks: DataFrame, latest: DataFrame, k: int = 8) -> DataFrame:
    """Active checks whose newest run failed, by severity, then recency."""
    bad = latest.filter(F.col("status").isin("fail", "error")).select("check_id", F.col("status").alias("run_status"), "started_at")
    joined = checks.filter(F.col("status") == "active").join(bad, "check_id")
    return joined.orderBy(F.lit(2) - lookup(F.col("severity"), SEVERITY_RANK, 0), F.desc("started_at"), F.asc("check_id")).limit(k)


def dataset_health(checks: DataFrame, latest: DataFrame) -> DataFrame:
    """Status-page health of each dataset with an active check: degraded, delayed, operational or unknown."""
    active = checks.filter(F.col("status") == "active").select("check_id", "dataset_id")
    joined = active.join(latest.select("check_id", F.col("status").alias("_s")), "check_id", "left")
    rank = F.max(lookup(F.col("_s"), STATUS_RANK))
    return joined.groupBy("dataset_id").agg(
        F.when(rank >= 2, "degraded").when(rank == 1, "delayed").when(rank == 0, "operational").otherwise("unknown").alias("health")
    )


def status_tiles(health: DataFrame, incidents: DataFrame, datasets: DataFrame) -> DataFrame:
    """Health tiles with open incidents, worst first."""
    facts = incidents.groupBy("dataset_id").agg(
        F.count_if(F.col("status").isin("open", "acknowledged")).alias("open_incidents"), F.max("last_seen_at").alias("last_incident_at")
    )
    joined = health.join(datasets.select("dataset_id", "table_name"), "dataset_id").join(facts, "dataset_id", "left")
    return joined.withColumn("open_incidents", F.coalesce("open_incidents", F.lit(0)).cast("bigint")).orderBy(
        F.desc(lookup(F.col("health"), HEALTH_RANK)), F.asc("table_name")
    )


def overall_status(health: DataFrame) -> DataFrame:
    """The worst state present; unknown only where nothing else is."""
    h = F.col("health")
    return health.agg(
        F.coalesce(
            F.max_by("health", lookup(h, HEALTH_RANK)), F.lit("unknown")
        ).alias("overall"),
        *[F.count_if(h == s).alias(s) for s in ("operational", "delayed", "degraded")],
    )


def lineage_health(runs: DataFrame, checks: DataFrame, exceptions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Graph-overlay health: failing newest runs, then open exceptions, then whether anything ran at all.

    Newest here is the highest run id, and only ``fail`` counts; the status page judges differently.
    """
    newest = last_per_key(runs.select("check_id", "run_id", "dataset_id", "status"), ["check_id"], ["run_id"])
    active = checks.filter(F.col("status") == "active").select("check_id").withColumn("_active", F.lit(True))
    ran = newest.join(active, "check_id", "left").groupBy("dataset_id").agg(
        F.count_if(F.col("_active").isNotNull() & (F.col("status") == "fail")).alias("failing_checks"), F.lit(True).alias("_ran")
    )
    opened = exceptions.filter(F.col("status") == "open").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("open_exceptions"))
    joined = datasets.select("dataset_id").join(ran, "dataset_id", "left").join(opened, "dataset_id", "left")
    fails, opens = F.coalesce("failing_checks", F.lit(0)), F.coalesce("open_exceptions", F.lit(0))
    health = F.when(fails > 0, "fail").when(opens > 0, "warn").when(F.col("_ran").isNotNull(), "pass").otherwise("unknown")
    return joined.select("dataset_id", health.alias("health"), fails.cast("bigint").alias("failing_checks"), opens.cast("bigint").alias("open_exceptions"))


def global_search(branches: Mapping[str, tuple[DataFrame, Column, Column]], needle: str, limit: int = 5) -> DataFrame:
    """Contains-match over several entity types: each limited, prefix matches first, then in branch order.

    ``branches`` maps a type to (table, id, title).
    """
    text, out = needle.strip().lower(), None
    for position, (kind, (df, ident, title)) in enumerate(branches.items()):
        hits = (
            df.select(F.lit(kind).alias("type"), ident.cast("bigint").alias("id"), title.alias("title"))
            .filter(F.contains(F.lower("title"), F.lit(text)))
            .orderBy("title", "id")
            .limit(limit)
            .withColumn("_order", F.lit(position))
        )
        out = hits if out is None else out.unionByName(hits)
    prefix = F.when(F.startswith(F.lower("title"), F.lit(text)), 0).otherwise(1)
    return out.withColumn("prefix_rank", prefix).orderBy("prefix_rank", "_order", "title", "id").drop("_order")


def visible(df: DataFrame, grants: DataFrame, user_id: int, role: str, key: str = "connection_id") -> DataFrame:
    """Rows a user may see: all for admins and for users without grants, else those on granted connections.

    Whether there are grants is one boolean, read as a scalar subquery.
    """
    if role == "admin":
        return df
    mine = grants.filter(F.col("user_id") == user_id).select(F.col(key)).distinct()
    unrestricted = mine.agg((F.count(F.lit(1)) == 0).alias("n")).scalar()
    marked = df.join(mine.withColumn("_granted", F.lit(True)), key, "left")
    return marked.filter(F.col("_granted").isNotNull() | unrestricted).select(*df.columns)


def effective_roles(grants: DataFrame, users: DataFrame) -> DataFrame:
    """Each grant's role capped by the user's own role."""
    rank = F.least(lookup(F.col("grant_role"), ROLE_RANK), lookup(F.col("user_role"), ROLE_RANK))
    role = F.when(rank == 2, "admin").when(rank == 1, "editor").otherwise("viewer")
    return grants.join(users, "user_id").select("user_id", "connection_id", role.alias("effective_role"))


def cascade_delete(tables: Mapping[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table after deleting datasets: dependents go, in dependency order.

    ``doomed`` has the dataset ids, distinct. Exceptions also go when they belong to a doomed run.
    """
    gone = doomed.select("dataset_id").distinct()
    keep = {name: df.join(gone, "dataset_id", "left_anti") for name, df in tables.items() if "dataset_id" in df.columns}
    if "exceptions" in tables and "check_runs" in tables:
        runs = tables["check_runs"].join(gone, "dataset_id", "left_semi").select("run_id").distinct()
        for column in ("run_id", "last_run_id"):
            if column in tables["exceptions"].columns:
                keep["exceptions"] = keep["exceptions"].join(runs.withColumnRenamed("run_id", column), column, "left_anti")
    if "slas" in tables and "checks" in tables:
        checks = tables["checks"].join(gone, "dataset_id", "left_semi")
        scopes = gone.select(F.lit("dataset").alias("scope"), F.col("dataset_id").alias("scope_id")).unionByName(
            checks.select(F.lit("check").alias("scope"), F.col("check_id").alias("scope_id"))
        )
        keep["slas"] = tables["slas"].join(scopes, ["scope", "scope_id"], "left_anti")
    return keep


def sort_datasets(
    datasets: DataFrame, *, domain: str | None = None, team: str | None = None, text: str | None = None, health: str = "all"
) -> DataFrame:
    """Filter a dataset list and put favourites first, then the most open exceptions.

    An empty ``domain`` or ``team`` matches datasets without one; None matches all.
    """
    out = datasets
    for name, value in (("domain", domain), ("team", team)):
        if value is not None:
            out = out.filter(F.lower(F.trim(F.coalesce(name, F.lit("")))) == value.strip().lower())
    if text:
        found = F.lit(False)
        for name in ("table_name", "connection_name", "owner", "domain", "team"):
            found = found | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(text.lower()))
        out = out.filter(found)
    if health != "all":
        out = out.filter(F.coalesce("health", F.lit("unknown")) == health)
    return out.orderBy(F.desc("is_favorite"), F.desc("open_exceptions"), F.asc("dataset_id"))

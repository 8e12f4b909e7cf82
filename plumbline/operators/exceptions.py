"""Exception lists: filters, pages, facets and saved-view counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import SEVERITY_RANK, lookup
from plumbline.functions.text import contains


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def with_checks(exceptions: DataFrame, checks: DataFrame) -> DataFrame:
    """Exceptions with their check's name, type, column and severity.

    No hint: the planner broadcasts the checks only while their measured size allows it.
    """
    facts = checks.select("check_id", "check_name", "check_type", "column_name", "severity")
    return exceptions.join(facts, "check_id")


@dataclass(frozen=True)
class Viewer:
    """Who looks, and when: what ``me`` and ``new`` mean."""

    as_of: datetime
    user_id: int | None = None


def _is(column: str) -> Callable[[Any, Viewer], Column]:
    return lambda value, _: F.col(column) == value


def _among(column: str) -> Callable[[Any, Viewer], Column]:
    return lambda values, _: F.col(column).isin(*values)


def _owner(who: str | int, viewer: Viewer) -> Column:
    mine = F.col("assigned_to_id")
    named = {"none": mine.isNull(), "me": F.lit(True) if viewer.user_id is None else mine == viewer.user_id}
    return named.get(str(who)) if str(who) in named else mine == int(who)


def _how_often(kind: str, viewer: Viewer) -> Column:
    return {"new": F.col("first_seen_at") >= at(viewer.as_of - NEW_FOR), "recurring": F.col("occurrence_count") >= RECURRING}[kind]


def _mentions(text: str, _: Viewer) -> Column:
    return reduce(Column.__or__, [contains(F.col(c), text) for c in ("reason", "note", "check_name")])


#: What is new, and from how many occurrences on a record recurs.
NEW_FOR, RECURRING = timedelta(hours=24), 2
#: The tests of the filter bar by the name of the filter.
TESTS: dict[str, Callable[[Any, Viewer], Column]] = {
    **{name: _is(name) for name in ("dataset_id", "check_id", "run_id", "check_type")}, **{name: _among(name) for name in ("status", "severity")},
    "assignee": _owner, "recurrence": _how_often, "seen_since": lambda since, _: F.col("last_seen_at") >= at(since), "text": _mentions,
}


def conditions(*, as_of: datetime, user_id: int | None = None, **asked: Any) -> dict[str, Column]:
    """The filters that are asked for, by their names in ``TESTS``, as conditions on the output of :func:`with_checks`.

    An empty filter (None, an empty text or list) asks for nothing; an unknown one is refused.
    """
    viewer = Viewer(as_of, user_id)
    return {name: TESTS[name](value, viewer) for name, value in asked.items() if value not in (None, "", [], ())}


def in_scope(enriched: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Exceptions of the datasets that someone may see; without a ``scope(dataset_id)`` all of them."""
    return enriched if scope is None else enriched.join(scope.select("dataset_id").distinct(), "dataset_id", "left_semi")


def filter_exceptions(enriched: DataFrame, scope: DataFrame | None = None, **filters: object) -> DataFrame:
    out = in_scope(enriched, scope)
    for condition in conditions(**filters).values():
        out = out.filter(condition)
    return out


def severity_order(severity: Column) -> Column:
    return F.lit(2) - lookup(severity, SEVERITY_RANK, 0)


def page(enriched: DataFrame, sort: str = "newest", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order: every sort ends with the id."""
    newest = F.desc("exception_id")
    order = {
        "newest": [newest],
        "oldest": [F.asc("exception_id")],
        "occurrences": [F.desc("occurrence_count"), newest],
        "severity": [severity_order(F.col("severity")), newest],
    }.get(sort, [newest])
    return enriched.orderBy(*order).offset(offset).limit(limit)


#: Sort keys by sort, each ascending; a position is the keys' values. Every sort ends with the id, so it is a total order.
SORTS: dict[str, Callable[[], list[Column]]] = {
    "newest": lambda: [-F.col("exception_id")],
    "oldest": lambda: [F.col("exception_id")],
    "occurrences": lambda: [-F.coalesce("occurrence_count", F.lit(0)), -F.col("exception_id")],
    "severity": lambda: [severity_order(F.col("severity")), -F.col("exception_id")],
}


def seek(enriched: DataFrame, sort: str = "newest", after: Sequence[int] | None = None, limit: int = 50) -> DataFrame:
    """The page that follows a position, with the ``position`` of each row; the last row's leads to the next page.

    Rows up to the position are filtered out in the scan's own stage, so each task keeps ``limit`` rows however far down
    the page is; an offset would hold all rows before it in one place.
    """
    place = F.array(*[key.cast("bigint") for key in SORTS[sort]()])
    placed = enriched.withColumn("position", place)
    if after is not None:
        beyond = F.struct(*[F.get("position", F.lit(i)) for i in range(len(after))])
        placed = placed.filter(beyond > F.struct(*[F.lit(int(v)).cast("bigint") for v in after]))
    return placed.orderBy("position").limit(limit)


def facets(enriched: DataFrame, top_datasets: int = 20, **filters: object) -> DataFrame:
    """``(facet, value, n)``: each facet counts under all filters but its own.

    The three value facets, the dataset facet and the total come out of one pre-aggregation over
    (status, severity, type, dataset), so the exceptions are read once.
    """
    named = conditions(**filters)
    own = {"status": "status", "severity": "severity", "check_type": "check_type"}
    shared = [cond for key, cond in named.items() if key not in own.values()]
    rows = enriched
    for cond in shared:
        rows = rows.filter(cond)
    cube = rows.groupBy("status", "severity", "check_type", "dataset_id").agg(F.count(F.lit(1)).alias("_n"))

    def under(skip: str | None) -> Column:
        keep = F.lit(True)
        for key in own.values():
            if key in named and key != skip:
                keep = keep & named[key]
        return keep

    cells = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), under(f).alias("_ok")) for f in own],
        F.struct(F.lit("dataset").alias("facet"), F.col("dataset_id").cast("string").alias("value"), under(None).alias("_ok")),
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"), under(None).alias("_ok")),
    )
    counted = (
        cube.select("_n", F.explode(cells).alias("_c"))
        .filter("_c._ok")
        .groupBy(F.col("_c.facet").alias("facet"), F.col("_c.value").alias("value"))
        .agg(F.sum("_n").alias("n"))
    )
    largest = counted.filter(F.col("facet") == "dataset").orderBy(F.desc("n"), F.asc(F.col("value").cast("bigint"))).limit(top_datasets)
    return counted.filter(F.col("facet") != "dataset").unionByName(largest)


def view_counts(enriched: DataFrame, user_id: int, as_of: datetime) -> DataFrame:
    """The six saved-view badges from one conditional aggregate over the open and expected rows."""
    c = F.col
    is_open = c("status") == "open"
    day_ago = at(as_of - timedelta(hours=24))
    return enriched.filter(c("status").isin("open", "expected")).agg(
        F.count_if(is_open & F.coalesce(c("assigned_to_id") == user_id, F.lit(False))).alias("my_open"),
        F.count_if(is_open & (c("first_seen_at") >= day_ago)).alias("new_today"),
        F.count_if(is_open & (c("severity") == "error")).alias("high_severity"),
        F.count_if(is_open & (c("occurrence_count") >= 2)).alias("recurring"),
        F.count_if(is_open & c("assigned_to_id").isNull()).alias("unassigned"),
        F.count_if(c("status") == "expected").alias("expected"),
    )


def display(exceptions: DataFrame, checks: DataFrame, datasets: DataFrame, users: DataFrame) -> DataFrame:
    """Exceptions with the names a list shows; an inactive assignee is marked."""
    people = users.select(
        F.col("user_id").alias("assigned_to_id"),
        F.concat(F.col("user_name"), F.when(F.col("is_active"), "").otherwise(" (inactive)")).alias("assignee"),
    )
    names = checks.select("check_id", "check_name", "severity")
    tables = datasets.select("dataset_id", "table_name")
    return exceptions.join(names, "check_id", "left").join(tables, "dataset_id", "left").join(people, "assigned_to_id", "left")


def filter_runs(
    runs: DataFrame,
    as_of: datetime,
    *,
    run_id: int | None = None,
    dataset_id: int | None = None,
    check_id: int | None = None,
    status: str | None = None,
    day: datetime | None = None,
    since: str | None = None,
) -> DataFrame:
    """Runs by identity, status and time; the time bounds are half-open, so day partitions prune."""
    windows = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "14d": timedelta(days=14)}
    if since is not None and since not in windows:
        raise ValueError(f"since must be one of {', '.join(windows)}")
    out = runs
    for name, value in (("run_id", run_id), ("dataset_id", dataset_id), ("check_id", check_id), ("status", status)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if day is not None:
        out = out.filter((F.col("started_at") >= at(day)) & (F.col("started_at") < at(day + timedelta(days=1))))
    if since is not None:
        out = out.filter(F.col("started_at") >= at(as_of - windows[since]))
    return out

"""Column catalogs, schema contracts, schema change and schema history."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.fingerprint import schema_fingerprint
from plumbline.functions.text import type_name
from plumbline.operators.ordered import PART, previous_row, running_totals, spread


def column_kind(kind: T.DataType) -> str:
    """numeric, temporal, string, boolean or other, from the Spark type."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def column_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per declared column of every table. Only schemas are read, no data."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (table, i, f.name, f.dataType.simpleString(), column_kind(f.dataType), f.nullable)
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, dtype string, kind string, nullable boolean")


def null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, name, null_count)``: the NULLs that each column holds, from one narrow pass per table."""
    out = None
    for table, df in tables.items():
        names = [f.name for f in df.schema.fields]
        counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
        lines = [F.struct(F.lit(c).alias("name"), (F.col("_rows") - F.col(f"_c{i}")).alias("null_count")) for i, c in enumerate(names)]
        part = counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return out


def contract_diff(
    expected: DataFrame, current: DataFrame, allow_additive: bool = True, case_sensitive: bool = False
) -> DataFrame:
    """Expected against current columns, one row per difference.

    ``expected`` may leave ``dtype`` and ``nullable`` NULL to accept anything. Additive columns are
    listed and marked as no violation where they are allowed.
    """
    key = (lambda c: c) if case_sensitive else F.lower
    left = expected.select(
        key(F.col("name")).alias("_key"), F.col("name").alias("_name"), F.col("dtype").alias("_type"), F.col("nullable").alias("_null")
    )
    right = current.select(
        key(F.col("name")).alias("_key"), F.col("name").alias("_cname"), F.col("dtype").alias("_ctype"), F.col("nullable").alias("_cnull")
    )
    both = left.join(right, "_key", "full_outer")
    name = F.coalesce("_name", "_cname")

    def change(kind: str, before: Column, after: Column, violation: bool = True) -> Column:
        return F.struct(
            F.lit(kind).alias("change"), before.cast("string").alias("expected"), after.cast("string").alias("actual"), F.lit(violation).alias("violation")
        )

    present = F.col("_name").isNotNull() & F.col("_cname").isNotNull()
    found = F.array(
        F.when(F.col("_cname").isNull(), change("missing", F.col("_type"), F.lit(None))),
        F.when(F.col("_name").isNull(), change("added", F.lit(None), F.col("_ctype"), not allow_additive)),
        F.when(present & (type_name(F.col("_type")) != type_name(F.col("_ctype"))), change("type_changed", F.col("_type"), F.col("_ctype"))),
        F.when(present & (F.col("_null") != F.col("_cnull")), change("nullability_changed", F.col("_null"), F.col("_cnull"))),
    )
    return both.select(name.alias("column_name"), F.explode(F.array_compact(found)).alias("_d")).select("column_name", "_d.*")


ALERTS = {"removed": True, "type_changed": True, "nullability_changed": True, "added": False, "reordered": False}


def schema_delta(before: Column, after: Column, ignore: Iterable[str] = (), alerts: Mapping[str, bool] | None = None) -> Column:
    """Differences of two ``array<struct<ordinal,name,dtype,nullable>>`` as an array of changes.

    A schema is a few columns, so both sides fit one row and no join is needed.
    """
    on = {**ALERTS, **(alerts or {})}
    hidden = list(ignore)
    visible = (lambda cols: F.filter(cols, lambda c: ~c["name"].isin(*hidden))) if hidden else (lambda cols: cols)
    old, new = F.array_sort(visible(before)), F.array_sort(visible(after))
    names = lambda cols: F.transform(cols, lambda c: c["name"])
    none = F.lit(None).cast("string")

    def line(kind: str, name: Column, frm: Column, to: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("change_type"),
            name.cast("string").alias("column_name"),
            frm.cast("string").alias("from_value"),
            to.cast("string").alias("to_value"),
            F.lit(bool(on[kind])).alias("alerting"),
        )

    twin = lambda c: F.get(F.filter(old, lambda o: o["name"] == c["name"]), F.lit(0))
    removed = F.transform(
        F.filter(old, lambda c: ~F.array_contains(names(new), c["name"])), lambda c: line("removed", c["name"], c["dtype"], none)
    )
    added = F.transform(
        F.filter(new, lambda c: ~F.array_contains(names(old), c["name"])), lambda c: line("added", c["name"], none, c["dtype"])
    )
    kept = F.filter(new, lambda c: F.array_contains(names(old), c["name"]))
    retyped = F.transform(
        F.filter(kept, lambda c: twin(c)["dtype"] != c["dtype"]),
        lambda c: line("type_changed", c["name"], twin(c)["dtype"], c["dtype"]),
    )
    renulled = F.transform(
        F.filter(kept, lambda c: twin(c)["nullable"] != c["nullable"]),
        lambda c: line("nullability_changed", c["name"], twin(c)["nullable"], c["nullable"]),
    )
    same_set = (F.size(removed) == 0) & (F.size(added) == 0)
    moved = F.when(same_set & (names(old) != names(new)), F.array(line("reordered", none, none, none))).otherwise(
        F.filter(F.array(line("reordered", none, none, none)), lambda _: F.lit(False))
    )
    return F.concat(removed, retyped, renulled, added, moved)


def schema_changes(
    snapshots: DataFrame, key: str, order: Sequence[str], chunk: Column, ignore: Iterable[str] = (), alerts: Mapping[str, bool] | None = None
) -> DataFrame:
    """Each snapshot of ``columns`` against the one before it; one row per change."""
    snapshots, chunk = spread(snapshots, [key], order, chunk)
    paired = previous_row(snapshots, [key], order, ["columns"], chunk)
    known = paired.filter(F.col("prev_columns").isNotNull())
    delta = schema_delta(F.col("prev_columns"), F.col("columns"), ignore, alerts)
    return known.select(key, *order, F.explode(delta).alias("_d")).select(key, *order, "_d.*")


def schema_history(snapshots: DataFrame, key: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Every snapshot with a summary of what changed since the one before it."""
    snapshots, chunk = spread(snapshots, [key], order, chunk)
    paired = previous_row(snapshots, [key], order, ["columns"], chunk)
    delta = schema_delta(F.col("prev_columns"), F.col("columns"))
    of = lambda kind: F.filter("_delta", lambda d: d["change_type"] == kind)
    listed = lambda kind: F.array_join(F.array_sort(F.transform(of(kind), lambda d: d["column_name"])), ",")
    known = F.col("prev_columns").isNotNull()
    return paired.withColumn("_delta", F.when(known, delta)).select(
        key,
        *order,
        F.when(known, listed("added")).alias("added"),
        F.when(known, listed("removed")).alias("removed"),
        F.when(known, F.size(of("type_changed"))).alias("type_changed"),
        F.when(known, F.size(of("nullability_changed"))).alias("nullability_changed"),
        F.when(known, F.size(of("reordered")) > 0).alias("reordered"),
    )


def drop_repeated_snapshots(snapshots: DataFrame, key: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Keep a snapshot only where its fingerprint differs from the one before it."""
    stamped = snapshots.withColumn("fingerprint", schema_fingerprint(F.col("columns")))
    stamped, chunk = spread(stamped, [key], order, chunk)
    paired = previous_row(stamped, [key], order, ["fingerprint"], chunk)
    return paired.filter(~F.col("prev_fingerprint").eqNullSafe(F.col("fingerprint"))).drop("prev_fingerprint", PART)


def append_snapshot(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming snapshots that differ from the newest stored one of their key."""
    newest = existing.groupBy(key).agg(
        F.max_by("fingerprint", F.struct(*[F.col(c) for c in order])).alias("_latest")
    )
    stamped = incoming.withColumn("fingerprint", schema_fingerprint(F.col("columns")))
    return stamped.join(newest, key, "left").filter(~F.col("_latest").eqNullSafe(F.col("fingerprint"))).drop("_latest")


def pinned_baseline(snapshots: DataFrame, key: str, snapshot_id: str) -> DataFrame:
    """The newest snapshot marked as baseline, per key; an aggregate, so no sort and no hot window."""
    return (
        snapshots.filter("is_baseline")
        .groupBy(key)
        .agg(F.max(snapshot_id).alias(snapshot_id), F.max_by("columns", snapshot_id).alias("columns"))
    )


def against_pinned(snapshots: DataFrame, key: str, snapshot_id: str, ignore: Iterable[str] = (), alerts: Mapping[str, bool] | None = None) -> DataFrame:
    """Differences of each key's newest snapshot from its pinned baseline."""
    newest = snapshots.groupBy(key).agg(F.max(snapshot_id).alias(snapshot_id), F.max_by("columns", snapshot_id).alias("columns"))
    base = pinned_baseline(snapshots, key, snapshot_id).select(key, F.col("columns").alias("_base"))
    delta = schema_delta(F.col("_base"), F.col("columns"), ignore, alerts)
    return newest.join(base, key).select(key, snapshot_id, F.explode(delta).alias("_d")).select(key, snapshot_id, "_d.*")


def numbered_versions(revisions: DataFrame, key: str, order: Sequence[str], definition: Sequence[str], chunk: Column) -> DataFrame:
    """Contiguous version numbers of a key's revisions; a revision that changes nothing gets none."""
    stamped = revisions.withColumn("_definition", F.struct(*[F.col(c) for c in definition]))
    stamped, chunk = spread(stamped, [key], order, chunk)
    paired = previous_row(stamped, [key], order, ["_definition"], chunk)
    changed = paired.filter(~F.col("prev__definition").eqNullSafe(F.col("_definition"))).drop("_definition", "prev__definition")
    return running_totals(changed, [key], order, {"version": F.lit(1)}, chunk).drop(PART)


def latest_version(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max("version").alias("version"))

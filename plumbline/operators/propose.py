"""Propose checks and monitors from profiles: rules over the profile table, for any number of tables at once."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import FORMAT_PATTERNS
from plumbline.operators.spec import CheckSpec

# Name hints and thresholds of the proposal rules.
ID_HINTS = ("id", "key", "code", "sku", "uuid")
MEASURE_HINTS = ("price", "amount", "total", "qty", "quantity", "count", "cost", "fee")
CONTACT_HINTS = ("email", "name", "phone")
TIME_HINTS = ("created", "updated", "date", "time", "_at", "ts")
TEMPORAL_PREFERENCE = ("updated", "modified", "event", "created", "date", "time", "_at", "ts")


def _hints(name: Column, hints: Sequence[str]) -> Column:
    return F.lower(name).rlike("|".join(hints))


def _proposal(check_type: str, column: Column, severity: Column | str, params: Column | None = None) -> Column:
    return F.struct(
        F.lit(check_type).alias("check_type"),
        column.cast("string").alias("column_name"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        (params if params is not None else F.lit("{}")).cast("string").alias("params"),
    )


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def profiled(facts: DataFrame, distinct: DataFrame, p99: DataFrame, values: DataFrame, table: str = "table_name") -> DataFrame:
    """Join profile parts into the table the rules read, with key candidates marked.

    ``values`` has the most frequent values of each column as an array; a closed domain is one that it lists whole.
    """
    on = [table, "column_name"]
    joined = facts.join(distinct, on, "left").join(p99, on, "left").join(values, on, "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    key = (F.col("row_count") >= 100) & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
    return joined.withColumn("is_key", key)


def column_proposals(columns: DataFrame, table: str = "table_name") -> DataFrame:
    """Checks that one column's profile suggests; a projection, so it scales with the number of columns."""
    c, name = F.col, F.col("column_name")
    rows, nulls, distinct = c("row_count"), c("null_count"), c("distinct_count")
    low, high, p99 = c("min_number"), c("max_number"), c("p99")
    numeric, string = c("kind") == "numeric", c("kind") == "string"
    spread = numeric & (high > low)
    measure = (low >= 0) & _hints(name, MEASURE_HINTS)
    pad = (high - low) * 0.5
    pattern = lambda p: string & (c(p) >= 0.95)
    certain = lambda p: F.when(c(p) < 1.0, "warn").otherwise("error")
    found = F.array(
        F.when((rows >= 100) & (nulls == 0), _proposal("not_null", name, F.when(c("is_key"), "error").otherwise("warn"))),
        F.when(
            (rows >= 100) & (c("null_pct") > 0) & (c("null_pct") <= 0.02) & _hints(name, CONTACT_HINTS),
            _proposal("not_null", name, "warn", _json(tolerance=nulls)),
        ),
        F.when(
            (rows >= 100) & (distinct == rows - nulls) & (nulls == 0) & (_hints(name, ID_HINTS) | c("is_key")),
            _proposal("unique", name, "error"),
        ),
        F.when(spread & measure, _proposal("range", name, "error", _json(min=F.lit(0)))),
        F.when(spread & ~measure, _proposal("range", name, "warn", _json(min=F.round(low - pad, 4), max=F.round(high + pad, 4)))),
        F.when(numeric & (p99 > 0) & (high > p99 * 20), _proposal("range", name, "warn", _json(max=F.round(p99 * 20, 4)))),
        *[F.when(pattern(p), _proposal("regex_match", name, certain(p), _json(pattern=F.lit(FORMAT_PATTERNS[p])))) for p in ("email", "uuid", "url")],
        F.when(
            string & (distinct > 0) & (distinct <= 10) & (rows >= 500) & ~_hints(name, ID_HINTS) & (F.size("values") == distinct),
            _proposal("accepted_values", name, "warn", _json(values=F.col("values"))),
        ),
        F.when(
            string & (rows >= 500) & (distinct > 0) & (distinct <= 20) & ~_hints(name, ID_HINTS),
            _proposal("distribution_drift", name, "info", _json(method=F.lit("psi"), threshold=F.lit(0.2))),
        ),
    )
    return columns.select(table, F.explode(F.array_compact(found)).alias("_p")).select(table, "_p.*")


def variance_proposals(columns: DataFrame, table: str = "table_name", k: int = 3) -> DataFrame:
    """Drift checks on each table's ``k`` most spread-out numeric columns."""
    usable = columns.filter((F.col("kind") == "numeric") & (F.col("row_count") >= 500) & (F.abs("stddev") > 0))
    rank = F.row_number().over(Window.partitionBy(table).orderBy(F.desc(F.abs("stddev")), F.desc("column_name")))
    top = usable.withColumn("_r", rank).filter(F.col("_r") <= k)
    line = _proposal("distribution_drift", F.col("column_name"), "info", _json(method=F.lit("psi"), threshold=F.lit(0.2)))
    return top.select(table, line.alias("_p")).select(table, "_p.*")


def table_proposals(columns: DataFrame, table: str = "table_name", knowledge: DataFrame | None = None) -> DataFrame:
    """Checks on the table as a whole. ``knowledge(table, freshness_sla_hours)`` says how old a table may be."""
    timed = F.col("max_ts").isNotNull() & _hints(F.col("column_name"), TIME_HINTS)
    facts = columns.groupBy(table).agg(
        F.max("row_count").alias("rows"),
        F.count_if(F.col("kind") == "numeric").alias("numeric"),
        F.min_by(F.when(timed, F.col("column_name")), F.when(timed, F.col("ordinal"))).alias("clock"),
        # As many entries as the table has columns.
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "dtype"))).alias("columns"),
        F.array_sort(F.collect_list(F.when(F.col("is_key"), F.col("column_name")))).alias("keys"),
    )
    facts = facts.join(knowledge, table, "left") if knowledge is not None else facts.withColumn("freshness_sla_hours", F.lit(None).cast("int"))
    sla = F.col("freshness_sla_hours")
    expected = F.transform("columns", lambda c: F.struct(c["column_name"].alias("name"), c["dtype"].alias("dtype")))
    # The settings of adaptive freshness.
    age = _json(strategy=F.lit("adaptive"), default_max_age_hours=F.coalesce(sla, F.lit(48)), min_history=F.lit(3), lookback_runs=F.lit(14), multiplier=F.lit(2.0), grace_hours=F.lit(1.0))
    none, rows = F.lit(None), F.col("rows")
    found = F.array(
        F.when(F.col("clock").isNotNull(), _proposal("freshness", F.col("clock"), F.when(sla.isNull(), "warn").otherwise("error"), age)),
        _proposal("schema_contract", none, "warn", _json(expected_columns=expected, allow_additive=F.lit(True), case_sensitive=F.lit(False))),
        _proposal("schema_change", none, "warn", _json(baseline=F.lit("previous"))),
        F.when(rows >= 100, _proposal("row_count_min", none, "error", _json(min_rows=F.greatest(F.lit(1), F.floor(rows / 2))))),
        F.when(rows >= 100, _proposal("row_count_anomaly", none, "warn", _json(strategy=F.lit("adaptive")))),
        F.when((rows >= 500) & (F.col("numeric") >= 2), _proposal("ml_outlier", none, "info", _json(contamination=F.lit(0.005), keys=F.when(F.size("keys") > 0, F.col("keys"))))),
    )
    return facts.select(table, F.explode(F.array_compact(found)).alias("_p")).select(table, "_p.*")


def propose_checks(columns: DataFrame, table: str = "table_name", knowledge: DataFrame | None = None) -> DataFrame:
    """All proposals; ``params`` is what the check type takes, as JSON."""
    return column_proposals(columns, table).unionByName(variance_proposals(columns, table)).unionByName(table_proposals(columns, table, knowledge))


def specs(proposals: DataFrame, table: str = "table_name", first_id: int = 1) -> dict[str, list[CheckSpec]]:
    """Proposals as checks that run, by table: as many as tables and columns give rise to."""
    out: dict[str, list[CheckSpec]] = {}
    for i, r in enumerate(proposals.orderBy(table, "check_type", "column_name", "params").collect()):
        params = json.loads(r["params"])
        tolerance = int(params.pop("tolerance", 0))
        out.setdefault(r[table], []).append(CheckSpec(first_id + i, r["check_type"], r["column_name"], params, r["severity"], tolerance))
    return out


def new_proposals(proposals: DataFrame, existing: DataFrame, table: str = "table_name") -> DataFrame:
    """Proposals for a (type, column) no check covers yet; of several, the one that sorts first."""
    key = [table, "check_type", "_column"]
    keyed = proposals.withColumn("_column", F.coalesce("column_name", F.lit("")))
    taken = existing.filter(F.col("status") != "archived").select(
        table, "check_type", F.coalesce("column_name", F.lit("")).alias("_column")
    ).distinct()
    body = F.struct("severity", "params")
    fresh = keyed.join(taken, key, "left_anti").groupBy(*key).agg(F.min(body).alias("_b"), F.count(F.lit(1)).alias("proposed"))
    return fresh.select(table, "check_type", F.nullif(F.col("_column"), F.lit("")).alias("column_name"), "_b.*", "proposed")


def monitor_specs(columns: DataFrame, table: str = "table_name", max_drift: int = 4) -> DataFrame:
    """The managed monitors of each table: freshness, volume, schema and up to ``max_drift`` drift columns."""
    name = F.lower("column_name")
    score = None
    for i, hint in enumerate(TEMPORAL_PREFERENCE):
        hit = F.when(name.contains(hint), len(TEMPORAL_PREFERENCE) - i)
        score = hit if score is None else score.when(name.contains(hint), len(TEMPORAL_PREFERENCE) - i)
    timed = F.col("max_ts").isNotNull()
    clock = F.max_by(F.when(timed, F.col("column_name")), F.when(timed, F.struct(score.otherwise(0).alias("s"), name.alias("n"))))

    def spec(kind: str, check_type: str, column: Column, severity: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(check_type).alias("check_type"), column.cast("string").alias("column_name"), F.lit(severity).alias("severity")
        )

    whole = columns.groupBy(table).agg(clock.alias("clock"))
    fixed = whole.select(
        table,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("clock").isNotNull(), spec("freshness", "freshness", F.col("clock"), "warn")),
                    spec("volume", "row_count_anomaly", F.lit(None), "warn"),
                    spec("schema", "schema_contract", F.lit(None), "warn"),
                )
            )
        ).alias("_s"),
    ).select(table, "_s.*")
    numeric = (F.col("kind") == "numeric") & ~F.col("is_key") & ~name.isin(*ID_HINTS) & (F.abs("stddev") > 0)
    category = (F.col("kind") == "string") & ~_hints(name, ID_HINTS) & (F.col("distinct_count") > 1) & (F.col("distinct_count") <= 20)
    order = [
        F.when(numeric, 0).otherwise(1),
        F.when(numeric, -F.abs("stddev")).otherwise(F.col("distinct_count")),
        F.when(numeric, F.lit("")).otherwise(F.col("column_name")),
        F.desc("column_name"),
    ]
    rank = F.row_number().over(Window.partitionBy(table).orderBy(*order))
    drift = columns.filter(numeric | category).withColumn("_r", rank).filter(F.col("_r") <= max_drift)
    line = spec("drift", "distribution_drift", F.col("column_name"), "info")
    return fixed.unionByName(drift.select(table, line.alias("_s")).select(table, "_s.*"))

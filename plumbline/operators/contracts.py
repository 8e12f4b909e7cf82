"""Data contracts: clauses, conformance and the default contract of a profiled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import type_name
from plumbline.operators.joins import last_per_key


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the highest id of each check."""
    return last_per_key(runs, ["check_id"], ["run_id"])


def clause_conformance(clauses: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each clause: pass only if the newest run passed, breached otherwise, unknown without a run."""
    newest = latest_runs(runs.select("check_id", "run_id", "status", "violation_count"))
    joined = clauses.join(newest.withColumnRenamed("status", "run_status"), "check_id", "left")
    status = F.when(F.col("run_status").isNull(), "unknown").when(F.col("run_status") == "pass", "pass").otherwise("breached")
    return joined.select(*clauses.columns, "run_id", "violation_count", status.alias("clause_status"))


def schema_clauses(contracts: DataFrame, current: DataFrame, contract: str = "contract_id") -> DataFrame:
    """The schema clause of each contract: status and problems, from expected and current columns.

    ``contracts`` has ``expected`` (an array of name, dtype, nullable, required) and the switches ``compare_types``,
    ``enforce_nullable`` and ``allow_extra``; ``current`` has ``columns`` (name, dtype, nullable). Names and types compare
    without case, a type that is not given fits any, and a column may be null unless it says otherwise. A contract that
    expects no columns is unknown. Each row holds the columns of one table, so nothing is grouped.
    """
    joined = contracts.join(current.select(contract, F.col("columns").alias("_now")), contract, "left").withColumn("_now", F.coalesce("_now", F.array().cast(current.schema["columns"].dataType)))
    same = lambda a, b: F.lower(a["name"]) == F.lower(b["name"])
    found = lambda e: F.get(F.filter("_now", lambda c: same(c, e)), F.lit(0))
    nullable = lambda c: F.coalesce(c["nullable"], F.lit(True))
    kind = lambda c: F.coalesce(type_name(c["dtype"]), F.lit(""))
    named = lambda cols, text: F.transform(cols, lambda c: F.concat(c["name"], F.lit(text)))
    of = lambda test: F.filter("expected", test)
    missing = of(lambda e: found(e).isNull() & F.coalesce(e["required"], F.lit(True)))
    retyped = of(lambda e: F.col("compare_types") & (kind(e) != "") & (kind(found(e)) != "") & (kind(e) != kind(found(e))))
    renulled = of(lambda e: F.col("enforce_nullable") & found(e).isNotNull() & (nullable(e) != nullable(found(e))))
    extra = F.filter("_now", lambda c: ~F.col("allow_extra") & ~F.exists("expected", lambda e: same(c, e)))
    problems = F.concat(named(missing, " is missing"), named(retyped, " has another type"), named(renulled, " differs in nullability"), named(extra, " is not declared"))
    judged = joined.withColumn("problems", problems)
    status = F.when(F.coalesce(F.size("expected"), F.lit(0)) <= 0, "unknown").when(F.size("problems") > 0, "breached").otherwise("pass")
    return judged.select(contract, F.lit("schema").alias("clause_id"), status.alias("clause_status"), F.when(status == "breached", F.col("problems")).otherwise(F.array().cast("array<string>")).alias("problems"))


def conformance(clause_status: DataFrame, contract: str = "contract_id") -> DataFrame:
    """Contract status: breached if any clause is, else unknown if any clause is, else pass."""
    s = F.col("clause_status")
    return clause_status.groupBy(contract).agg(
        F.when(F.bool_or(s == "breached"), "breached").when(F.bool_or(s == "unknown"), "unknown").otherwise("pass").alias("status"),
        F.count(F.lit(1)).alias("clauses"),
        F.count_if(s == "breached").alias("breached_clauses"),
        F.count_if(s == "unknown").alias("unknown_clauses"),
    )


def default_contract(columns: DataFrame, table: str = "table_name") -> DataFrame:
    """Starter clauses from a profile: one per column, plus a volume clause per table that has rows."""
    schema = columns.select(
        table,
        F.lit("schema").alias("kind"),
        "column_name",
        F.col("dtype").alias("expected"),
        (F.col("null_count") > 0).alias("nullable"),
    )
    volume = columns.groupBy(table).agg(F.max("row_count").alias("_rows")).filter(F.col("_rows") > 0).select(
        table,
        F.lit("volume").alias("kind"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("min_rows=1").alias("expected"),
        F.lit(None).cast("boolean").alias("nullable"),
    )
    return schema.unionByName(volume)

"""Row-level checks as predicates: a check is one Column, so many checks share one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranks import run_status
from plumbline.operators.spec import CheckSpec

ROW_CHECKS = ("not_null", "accepted_values", "range", "string_length", "regex_match")


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def violation_predicate(spec: CheckSpec) -> Column | None:
    """True for violating rows, false or NULL otherwise; None where no single row decides."""
    if spec.check_type not in ROW_CHECKS:
        return None
    value, params = F.col(f"`{spec.column}`"), spec.params
    if spec.check_type == "not_null":
        return value.isNull()
    if spec.check_type == "accepted_values":
        if params.get("case_sensitive", True):
            return value.isNotNull() & ~value.isin(*params["values"])
        folded = [str(v).lower() for v in params["values"]]
        return value.isNotNull() & ~F.lower(value.cast("string")).isin(*folded)
    if spec.check_type == "range":
        low, high = params.get("min"), params.get("max")
        return value.isNotNull() & _any(
            ([value < F.lit(low)] if low is not None else []) + ([value > F.lit(high)] if high is not None else [])
        )
    if spec.check_type == "string_length":
        low, high = params.get("min_len"), params.get("max_len")
        length = F.char_length(value)
        return value.isNotNull() & _any(
            ([length < int(low)] if low is not None else []) + ([length > int(high)] if high is not None else [])
        )
    pattern = f"^(?:{params['pattern']})" if params.get("anchored") else params["pattern"]
    return value.isNotNull() & ~value.rlike(pattern)


def healthy_predicate(spec: CheckSpec) -> Column | None:
    """The exact complement over all rows: NULL cells are healthy unless the check is about NULLs."""
    bad = violation_predicate(spec)
    return None if bad is None else ~F.coalesce(bad, F.lit(False))


def reason(spec: CheckSpec) -> Column:
    """Why a row violates, as text."""
    value, params = F.col(f"`{spec.column}`"), spec.params
    shown = F.coalesce(value.cast("string"), F.lit("NULL"))
    if spec.check_type == "not_null":
        return F.lit(f"{spec.column} is NULL")
    if spec.check_type == "accepted_values":
        return F.concat(F.lit(f"{spec.column} = "), shown, F.lit(" not in the accepted set"))
    if spec.check_type == "range":
        low, high = params.get("min"), params.get("max")
        bounds = f"[{'-inf' if low is None else low}, {'inf' if high is None else high}]"
        return F.concat(F.lit(f"{spec.column} = "), shown, F.lit(f" outside {bounds}"))
    if spec.check_type == "string_length":
        bounds = f"[{params.get('min_len')}, {params.get('max_len')}]"
        return F.concat(F.lit(f"length of {spec.column} = "), F.char_length(value).cast("string"), F.lit(f" outside {bounds}"))
    return F.concat(F.lit(f"{spec.column} = "), shown, F.lit(f" does not match {params['pattern']}"))


def count_where(predicate: Column) -> Column:
    return F.count_if(F.coalesce(predicate, F.lit(False)))


def violations(df: DataFrame, spec: CheckSpec) -> DataFrame:
    """The violating rows with a reason. Uncapped: callers that want a sample take one."""
    return df.filter(violation_predicate(spec)).withColumn("reason", reason(spec)).withColumn("score", F.lit(None).cast("double"))


def sample_violations(df: DataFrame, order: list[str | Column], n: int = 50) -> DataFrame:
    """The first ``n`` violating rows in a stable order."""
    return df.orderBy(*order).limit(n)


def check_result(df: DataFrame, spec: CheckSpec) -> DataFrame:
    """Count and status of one row check: one pass, one row."""
    counts = df.agg(F.count(F.lit(1)).alias("rows_evaluated"), count_where(violation_predicate(spec)).alias("violation_count"))
    return with_status(counts, spec)


def with_status(counts: DataFrame, spec: CheckSpec) -> DataFrame:
    """Stamp a one-row result with the check's identity and its status."""
    return counts.select(
        F.lit(spec.check_id).cast("int").alias("check_id"),
        F.lit(spec.check_type).alias("check_type"),
        F.lit(spec.column).cast("string").alias("column_name"),
        *[F.col(c) for c in counts.columns],
        run_status(F.col("violation_count"), F.lit(spec.tolerance), F.lit(spec.severity)).alias("status"),
    )

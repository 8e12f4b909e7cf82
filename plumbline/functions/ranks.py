"""Severity, status, role and importance vocabularies as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the monitored platform's vocabulary for results to agree.
SEVERITY_RANK = {"info": 0, "warn": 1, "error": 2}
SEVERITY_WEIGHT = {"info": 0.5, "warn": 1.0, "error": 2.0}
STATUS_RANK = {"pass": 0, "warn": 1, "fail": 2, "error": 3}
STATUS_POINTS = {"pass": 1.0, "warn": 0.7, "fail": 0.0, "error": 0.0, "unknown": 0.5}
IMPORTANCE_WEIGHT = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
DEFAULT_SLO_TARGET = {"critical": 98.0, "high": 95.0, "medium": 90.0, "low": 85.0}
ROLE_RANK = {"viewer": 0, "editor": 1, "admin": 2}
HEALTH_RANK = {"unknown": 0, "operational": 1, "delayed": 2, "degraded": 3}


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """``table[key]`` as a CASE chain, which stays inside generated code."""
    chain = None
    for name, value in table.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def _folded(value: Column, default: str) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text == "", F.lit(default)).otherwise(text)


def normalise_importance(value: Column) -> Column:
    folded = _folded(value, "medium")
    return F.when(folded.isin(*IMPORTANCE_WEIGHT), folded).otherwise(F.lit("medium"))


def normalise_status(value: Column) -> Column:
    folded = _folded(value, "unknown")
    return F.when(folded.isin(*STATUS_RANK), folded).otherwise(F.lit("unknown"))


def severity_weight(value: Column) -> Column:
    return lookup(_folded(value, "error"), SEVERITY_WEIGHT, SEVERITY_WEIGHT["error"])


def run_status(violations: Column, tolerance: Column, severity: Column) -> Column:
    """Within tolerance passes; beyond it info and warn checks warn, all others fail."""
    return (
        F.when(violations <= tolerance, F.lit("pass"))
        .when(severity.isin("info", "warn"), F.lit("warn"))
        .otherwise(F.lit("fail"))
    )


def worst_status(rank: Column) -> Column:
    """The status name of a rank; NULL where there is no rank."""
    return F.when(rank == 3, "error").when(rank == 2, "fail").when(rank == 1, "warn").when(rank == 0, "pass")

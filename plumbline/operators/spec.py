"""Check definitions and the registry of check types."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CheckSpec:
    """One check on one table."""

    check_id: int
    check_type: str
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "error"
    tolerance: int = 0
    dataset_id: int | None = None
    name: str = ""

    def __post_init__(self) -> None:
        kind = CHECK_TYPES.get(self.check_type)
        if kind is None:
            raise ValueError(f"unknown check type {self.check_type!r}")
        if kind.needs_column and not self.column:
            raise ValueError(f"{self.check_type} needs a column")
        missing = [p for p in kind.required if self.params.get(p) in (None, "", [], ())]
        if missing:
            raise ValueError(f"{self.check_type} needs {', '.join(missing)}")
        if kind.any_of and all(self.params.get(p) in (None, "", [], ()) for p in kind.any_of):
            raise ValueError(f"{self.check_type} needs one of {', '.join(kind.any_of)}")
        if self.tolerance < 0:
            raise ValueError("tolerance must not be negative")


@dataclass(frozen=True)
class CheckType:
    """How to find the violating rows of a check type."""

    key: str
    needs_column: bool = True
    required: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    violations: Callable[[DataFrame, CheckSpec, DataFrame | None], DataFrame] | None = None


CHECK_TYPES: dict[str, CheckType] = {}


def register_check(
    key: str,
    violations: Callable[[DataFrame, CheckSpec, DataFrame | None], DataFrame] | None = None,
    *,
    needs_column: bool = True,
    required: tuple[str, ...] = (),
    any_of: tuple[str, ...] = (),
) -> None:
    """Make a check type known. ``violations(df, spec, history)`` returns the violating rows."""
    CHECK_TYPES[key] = CheckType(key, needs_column, required, any_of, violations)


register_check("not_null")
register_check("unique")
register_check("accepted_values", any_of=("values", "values_from"))
register_check("range", any_of=("min", "max"))
register_check("string_length", any_of=("min_len", "max_len"))
register_check("regex_match", required=("pattern",))
register_check("schema_contract", needs_column=False, required=("expected_columns",))
register_check("schema_change", needs_column=False)
register_check("freshness")
register_check("row_count_min", needs_column=False)
register_check("row_count_anomaly", needs_column=False)
register_check("custom_sql", needs_column=False, required=("sql",))
register_check("ml_outlier", needs_column=False)
register_check("distribution_drift")

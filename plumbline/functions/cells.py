"""Cell-level transforms for results that leave the engine: masking, truncation, export safety, JSON safety."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[REDACTED]"


def redact(df: DataFrame, pii: Iterable[str]) -> DataFrame:
    """Mask the non-null cells of the named columns; names match in any case."""
    hidden = {name.lower() for name in pii}
    return df.select(
        *[
            F.when(F.col(f"`{c}`").isNotNull(), F.lit(MASK)).alias(c) if c.lower() in hidden else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def redact_json(document: Column, pii: Iterable[str]) -> Column:
    """Mask the named top-level keys of a JSON object held as text."""
    hidden = [name.lower() for name in pii]
    entries = F.from_json(document, "map<string,string>")
    masked = F.transform_values(
        entries,
        lambda k, v: F.when(F.lower(k).isin(*hidden) & v.isNotNull(), F.lit(MASK)).otherwise(v),
    )
    return F.to_json(masked)


def truncate(df: DataFrame, limit: int = 200) -> DataFrame:
    """Shorten long strings and mark the cut with an ellipsis."""

    def cell(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return c
        return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def spreadsheet_safe(value: Column) -> Column:
    """Prefix a quote where a spreadsheet would read the cell as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def flat_cell(value: Column) -> Column:
    """A cell that fits a tab-separated line."""
    return spreadsheet_safe(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\t\r\n]+", " "))


def jsonable(df: DataFrame) -> DataFrame:
    """Only JSON-safe cells: finite numbers, ISO timestamps, text for nested values."""

    def cell(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            broken = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            c = F.when(~broken, c)
        elif isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.BinaryType):
            c = F.decode(c, "UTF-8")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        return c.alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def unique_names(names: list[str]) -> list[str]:
    """Number repeated column names: ``id, id`` becomes ``id, id_2``."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out

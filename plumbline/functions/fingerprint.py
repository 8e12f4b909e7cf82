"""Stable identities for violating rows and for schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_fingerprint(check_id: Column, columns: Sequence[str]) -> Column:
    """SHA-256 over the check and the row's identifying cells as JSON with sorted keys.

    Nulls are kept, so a null cell and a missing column differ. Two equal rows share it whatever
    partition they sit in, so it doubles as an evenly spread shuffle key.
    """
    cells = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)])
    identity = F.to_json(cells, {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("|", check_id.cast("string"), identity), 256)


def schema_fingerprint(columns: Column) -> Column:
    """SHA-256 over an ``array<struct<ordinal,name,dtype,nullable>>`` in ordinal order."""
    parts = F.transform(
        F.array_sort(columns),
        lambda c: F.concat_ws(
            ":", c["ordinal"].cast("string"), c["name"], c["dtype"], c["nullable"].cast("string")
        ),
    )
    return F.sha2(F.array_join(parts, ","), 256)


_OTHER = bytes(33)


def packed(fingerprint: Column) -> Column:
    """A fingerprint in binary, half as long; texts that are no SHA-256 digest keep their letters after 33 zero bytes."""
    return F.when(fingerprint.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(fingerprint)).otherwise(F.concat(F.lit(_OTHER), F.encode(fingerprint, "UTF-8")))


def unpacked(data: Column) -> Column:
    """The fingerprint that was packed."""
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(F.decode(F.substring(data, len(_OTHER) + 1, 2**31 - 1), "UTF-8"))

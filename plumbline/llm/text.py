"""What several operators share: word rules, row checks and the text of a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs without ASCII blanks, as ``bytes.split`` takes them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def whole(text: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: str) -> Column:
    """The number of words; a text that starts with a blank has an empty first field."""
    return F.size(F.filter(F.split(whole(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()


def in_slice(id_text: Column, parts: int) -> Column:
    """crc32 of an id's text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_text.cast("string"), F.lit("")).cast("binary")) % parts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Awkward documents, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, id string, size long, label string, measures string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, blanks, repeats, ties, a long text, odd characters, and columns named as the operators name theirs."""
    base = prose(1, 120)
    texts: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "  \n\t "), (4, base), (4, base), (5, base), (None, base), (None, None), (6, prose(2, 30_000)), (7, "\x1c\x85 café 中文 \U0001f600 <|endoftext|>  x"),
        (8, base + " tail"), (9, "one two"), (10, "Licensed under the Apache License, Version 2.0. CC BY! " + base), (11, base.replace("a", "z")), (12, "!!! ???"), (13, "été  l'été\n\n\nx"),
    ]
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", 0, None, "r", "i", 5, "l", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    inside = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)

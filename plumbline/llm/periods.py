"""Runs of repeated words by online dyadic square catching.

The documents of a batch are one stream of words, each document closed by a word that equals no other. Whenever ``2 ** k``
words more are complete, they are a block, and a catcher holds it. A square whose half has ``p`` words, with
``2 ** (k + 1) <= p < 2 ** (k + 2)``, has such a block in its first half and the same words ``p`` words later. So each
appended word ends a suffix of ``2 ** k`` words that is compared, by its rolling hash, with the two blocks whose catchers
look that far ahead: one step of all appended words at once for each of ``log(n)`` block sizes.

Catches of equal ``p`` at consecutive blocks belong to one stretch. Stretches that can be long enough are compared word by
word from a block before the first catch to a block after the last one, which gives the whole run whatever the hashes
say. Stretches inside a run whose period divides ``p`` are that run and are left out, so that the work stays near
``n log(n)`` also for a text of one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import portions
from plumbline.llm.text import WORD, mixed, whole

#: A run repeats its period so many times at least, and has so many words.
EXPONENT, LEAST_WORDS = 4, 6
#: Bytes of text of a batch; stretches compared word by word at once, in words.
AT_ONCE, COMPARED = 4_000_000, 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's words begin (one more number than texts)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), upto[offsets - offsets[0]]


def stretches(p: np.ndarray, block: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Catches merged: the distance, the first word of the first block and the end of the last block of each stretch."""
    key = np.sort(p * (np.int64(1) << 40) + block)
    p, block = key >> 40, key & ((1 << 40) - 1)
    new = np.append(True, (p[1:] != p[:-1]) | (block[1:] != block[:-1] + 1)) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(first) else first
    return p[first], block[first] * size, (block[last] + 1) * size


def equal_stretches(codes: np.ndarray, p: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """All maximal stretches in which words ``p`` apart are equal, of ``least`` words or more, between begin and end."""
    found = [np.zeros((0, 3), np.int64)]
    cost = np.cumsum(end - begin)
    at = 0
    while at < len(p):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + COMPARED, "right")))
        own, lengths = slice(at, upto), (end - begin)[at:upto]
        # A place that is never equal closes each stretch, so that none runs into the next one.
        closes = np.cumsum(lengths + 1)
        place = np.arange(closes[-1]) + np.repeat(begin[own] - (closes - lengths - 1), lengths + 1)
        other = place + np.repeat(p[own], lengths + 1)
        same = (codes[np.minimum(place, len(codes) - 1)] == codes[np.minimum(other, len(codes) - 1)]) & (other < len(codes))
        same[closes - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        of = np.searchsorted(closes, starts, "right") + at
        long = ends - starts >= least[of]
        found.append(np.stack([place[starts[long]], (ends - starts)[long] + p[of[long]], p[of[long]]], axis=1))
        at = upto
    return np.concatenate(found)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """One row per stretch: equal stretches of several periods are one run of the smallest."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def inside_known(runs: np.ndarray, p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which stretches lie in a known run whose period divides ``p``.

    Of the runs that begin no later, the one that ends last is looked at: a stretch of three periods or more lies in one
    run of a smaller period at most.
    """
    if not len(runs):
        return np.zeros(len(p), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = runs[:, 0] + runs[:, 1]
    most = np.maximum.accumulate(ends)
    which = np.maximum.accumulate(np.where(ends == most, np.arange(len(ends)), 0))
    at = np.searchsorted(runs[:, 0], begin, "right") - 1
    known = which[np.maximum(at, 0)]
    return (at >= 0) & (most[np.maximum(at, 0)] >= end) & (p % runs[known, 2] == 0)


def catch(codes: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT) -> np.ndarray:
    """The runs of all documents: rows of (start in ``codes``, length, period) by start, then period.

    ``codes`` are the numbers of the words of all documents in a row, ``starts`` where each document begins (and all end).
    A run's length is ``exponent`` (2 or more) times its smallest period at least, and no neighbouring word prolongs it.
    """
    lengths = np.diff(starts)
    # The stream: the words of a document, then a word of its own.
    shift = np.repeat(np.arange(len(lengths)), lengths)
    stream = np.empty(len(codes) + len(lengths), np.int64)
    stream[np.arange(len(codes)) + shift] = codes
    stream[starts[1:] + np.arange(len(lengths))] = -1 - np.arange(len(lengths))
    size = np.repeat(lengths, lengths + 1)
    place = np.arange(len(stream))
    suffix = mixed(stream.astype(np.uint64) * _STEP)
    runs = np.zeros((0, 3), np.int64)
    block = 1
    while True:
        # Documents too short for a run of this size leave the stream; blocks are counted anew in what stays.
        stay = size >= exponent * (block * 2 if block > 1 else 1)
        if not stay.any():
            break
        if not stay.all():
            suffix, place, size = suffix[stay], place[stay], size[stay]
        n_blocks = -(-len(suffix) // block)
        ahead = np.append(suffix, np.zeros(n_blocks * block - len(suffix), np.uint64)).reshape(n_blocks, block)
        held = ahead[:, 0]
        caught_p, caught_block = [], []
        for back in (2, 3) if block > 1 else (1, 2, 3):
            # The catchers of block j compare the suffixes that begin ``back`` blocks later.
            nth, offset = np.nonzero(ahead[back:] == held[: max(n_blocks - back, 0), None])
            caught_p.append(back * block + offset)
            caught_block.append(nth)
        p, begin, end = stretches(np.concatenate(caught_p).astype(np.int64), np.concatenate(caught_block).astype(np.int64), block)
        long = end - begin + 2 * (block - 1) >= (exponent - 1) * p
        p, begin, end = p[long], place[begin[long]], place[begin[long]] + (end - begin)[long]
        new = ~inside_known(runs, p, begin, end + p)
        p, begin, end = p[new], begin[new], end[new]
        begin, end = np.maximum(begin - block, 0), np.minimum(end + block, len(stream))
        runs = smallest_periods(np.concatenate([runs, equal_stretches(stream, p, begin, end, (exponent - 1) * p)]))
        if len(suffix) <= block:
            break
        # The suffix of twice the size that begins at a word: its first half, then its second.
        suffix = mixed(suffix[:-block] * _STEP + np.uint64(block)) + suffix[block:]
        place, size, block = place[: len(suffix)], size[: len(suffix)], block * 2
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    runs[:, 0] -= np.searchsorted(starts[1:] + np.arange(len(lengths)), runs[:, 0], "right")
    return runs


def collapsed(batch: pa.RecordBatch, exponent: int, least_words: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and its words without those that repeat a run's first period."""
    words, starts = split_words(batch.column("text"))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = catch(codes, starts, exponent)
    runs = runs[runs[:, 1] >= least_words]
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    begin, length, period = runs.T
    fields = [pa.array(np.ascontiguousarray(x)) for x in (begin - starts[of], length, period)]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))])
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, begin + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[starts]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(kept))), " ")
    return lists, texts


def collapse(docs: DataFrame, exponent: int = EXPONENT, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``runs`` (start, length, period by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by single blanks, without those that a run contains after its first period.
    Null and empty texts have no words and no runs. Rows that repeat are treated one by one, other columns are not read,
    and an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), whole(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at_once=AT_ONCE):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *collapsed(batch, exponent, least_words)], names=["id", "runs", "collapsed"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def planted(identifier: Column, text: Column) -> Column:
    """Texts of which one in ten, by id, has its words from a place on replaced by a repeated passage of its own.

    With h the crc32 of the id and g = h / 10 (whole), texts with h % 10 = 0 and n > 0 words are changed: each word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8) (whole).
    """
    h = F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    changed = F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)
    return F.when(h % 10 == 0, changed).otherwise(text)


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``collapse`` of planted texts: the number of runs, the run of greatest exponent, and digests of runs and words."""
    body = docs.select(F.col(f"`{id_column}`").alias("id"), planted(F.col(f"`{id_column}`"), whole(f"`{text}`")).alias("text"))
    rows = collapse(body, id_column="id")
    # Of two runs the one with the greater length / period stays; runs come by start, then period, so the first one of ties.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = rows.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        F.col("id").alias(id_column), "n_runs", *[F.col(f"best.{c}").alias(c) for c in RUN.names], F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )

"""Harmonic packing of documents into fixed-length training sequences.

A length class is a reciprocal of the capacity: class k takes pieces of ``capacity // k`` tokens, and exactly k of them
fill a sequence. Documents are cut into pieces of class lengths, so a sequence of class k wastes ``capacity % k`` tokens at
most, and only classes that waste ``WASTE`` or less exist. Workers count their pieces by class; the sums of the workers
before give each its first place, after which all pieces are placed independently, without meeting in one task.

The pieces that do not fill a last sequence of their class are fewer than k per class, however many documents there are.
They are cut into powers of two, which fill sequences of power-of-two lengths without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import byte_bpe, encoder, portions
from plumbline.llm.text import whole
from plumbline.session import stored

CAPACITY, WASTE, END = 2048, 8, 1
_LONG = T.LongType()


def class_lengths(capacity: int = CAPACITY, waste: int = WASTE) -> list[int]:
    """The lengths of the classes, largest first; the last is 1."""
    return [capacity // k for k in range(1, capacity + 1) if capacity // (capacity // k) == k and capacity - k * (capacity // k) <= waste]


def binary_parts(length: int) -> list[int]:
    """A length as powers of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _cuts(capacity: int) -> list[list[int]]:
    """For every length below the capacity, the class lengths it is cut into, largest first."""
    lengths, cuts = class_lengths(capacity), [[] for _ in range(capacity)]
    for n in range(1, capacity):
        first = next(x for x in lengths if x <= n)
        cuts[n] = [first, *cuts[n - first]]
    return cuts


def _schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    names = ["start", "length", "ids_crc32", "doc_tokens", "worker", "nth"]
    fields = [T.StructField("id", id_type), *[T.StructField(c, _LONG) for c in names], T.StructField("part_crc32", T.ArrayType(_LONG))]
    return T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))


def _cutter(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, placed, cuts = TaskContext.get().partitionId(), dict.fromkeys(class_lengths(capacity), 0), _cuts(capacity)
        for batch in portions(batches):
            ids, starts = encoder(path).encode(batch.column(1), END)
            raw = memoryview(ids.astype("<u4").tobytes())
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                begin, n = int(starts[row]), int(starts[row + 1] - starts[row])
                at = 0
                for length in [capacity] * (n // capacity) + cuts[n % capacity]:
                    place = 4 * (begin + at)
                    edges = list(accumulate(binary_parts(length), initial=0))
                    parts = [zlib.crc32(raw[place + 4 * a : place + 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                    crc = parts[0] if len(parts) == 1 else zlib.crc32(raw[place : place + 4 * length])
                    rows.append((row, at, length, crc, n, placed[length], parts))
                    placed[length] += 1
                    at += length
            row_of, at, length, crc, n, nth, parts = zip(*rows, strict=True)
            columns = [batch.column(0).take(pa.array(row_of)), *[pa.array(x, pa.int64()) for x in (at, length, crc, n)], pa.array([worker] * len(rows), pa.int64()), pa.array(nth, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "worker", "nth", "part_crc32"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)  # the pieces are the ids in their order, cut
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], list[tuple]]:
    """Where pieces go: (length, per sequence, pieces in full sequences, first sequence) by class, and the rest.

    The rest is (length, number within the rest, part, start in the piece, part's length, sequence, offset): at most
    ``capacity`` pieces of a class, a number of rows that the capacity bounds.
    """
    classes, rest, free = [], [], 0
    for length in sorted(counts, reverse=True):
        fit = capacity // length
        full = counts[length] // fit * fit
        classes.append((length, fit, full, free))
        free += full // fit
        rest += [(length, i) for i in range(counts[length] - full)]
    by_size: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, i in rest:
        parts = binary_parts(length)
        for k, (part, start) in enumerate(zip(parts, accumulate(parts, initial=0), strict=False)):
            by_size.setdefault(part, []).append((length, i, k, start))
    placed = []
    for size in sorted(by_size, reverse=True):
        pieces, at = by_size[size], 0
        while at < len(pieces):  # whole sequences, then ever smaller powers of two
            take = min(capacity // size, 1 << ((len(pieces) - at).bit_length() - 1))
            placed += [(length, i, k, start, size, free, slot * size) for slot, (length, i, k, start) in enumerate(pieces[at : at + take])]
            at, free = at + take, free + 1
    return classes, placed


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its ids and an end id; a null or empty text is the end id alone. Each id lies in one piece. Rows that
    repeat an id, whatever their texts, are separate documents; a null id stays null. An empty table gives no rows.
    Other columns are not read. ``sequence_id`` counts from 0 without gaps; offsets in a sequence have no gaps either.
    """
    id_type = docs.schema[id_column].dataType
    body = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    pieces = stored(body.mapInArrow(_cutter(tokenizer or byte_bpe(), capacity, with_ids), _schema(id_type, with_ids)), "pieces")
    by_worker = stored(pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    first = by_worker.select("length", "worker", F.coalesce(before, F.lit(0)).alias("before"))
    classes, rest = plan({r["length"]: r["n"] for r in by_worker.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # a row per class
    spark = docs.sparkSession
    known = spark.createDataFrame(classes, "length long, fit long, full long, first_sequence long")
    ranked = pieces.join(first, ["length", "worker"]).withColumn("place", F.col("before") + F.col("nth")).join(F.broadcast(known), "length")
    extra = ["ids"] if with_ids else []
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *extra]
    filled = ranked.filter("place < full").withColumns({"sequence_id": F.expr("first_sequence + place div fit"), "offset": F.col("place") % F.col("fit") * F.col("length")})
    where = spark.createDataFrame(rest, "length long, rest long, part int, part_start long, part_length long, sequence_id long, offset long")
    left = ranked.filter("place >= full").withColumn("rest", F.col("place") - F.col("full")).join(F.broadcast(where), ["length", "rest"])
    if with_ids:
        left = left.withColumn("ids", F.slice("ids", F.col("part_start").cast("int") + 1, F.col("part_length").cast("int")))
    left = left.withColumns({"ids_crc32": F.get("part_crc32", F.col("part")), "start": F.col("start") + F.col("part_start"), "length": F.col("part_length")})
    return filled.select(*names).union(left.select(*names)).withColumnRenamed("id", id_column)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id`` and ``ids``, padded to the capacity unless their length is a power of two."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # one sequence, so at most ``capacity`` ids
    ids = F.flatten(F.col("parts.ids"))
    missing = F.when(F.bit_count(F.size(ids)) == 1, 0).otherwise(capacity - F.size(ids))
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), missing)).alias("ids"))

"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a target of words. Its documents, in an order drawn from their ids, form a stream that is repeated until
the target is met. A source's weight changes linearly over the training time; its integral is the cumulative demand, and
inverting that demand at a document's place in the stream gives the time at which the document is trained on.

No source is handled in one task: the order is cut into chunks by its leading bits, sums of chunks are carried from chunk
to chunk, and only the documents of one chunk are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import WORD, whole
from plumbline.session import stored

#: Weights of the sources in their order, and how the weight moves: at the start, relative to its mean; the end mirrors it.
WEIGHTS, STARTS = (5, 2, 1), (1.5, 1.0, 0.5)
MOST_REPEATS = 3
#: Documents of a chunk, about.
CHUNK = 5_000


def size_of(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` -> with ``number``, ``weight``, ``start``, ``target``; one row per source.

    Targets share all words by weight and stop at ``MOST_REPEATS`` times the source's size. Sources that reach their
    limit first have the smallest limit for their weight, so one pass in that order settles who is limited.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = (F.row_number().over(in_order) - 1) % len(WEIGHTS)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), cycle)
    rows = sizes.select("source", "source_size", F.row_number().over(in_order).alias("number"), pick(WEIGHTS).cast("long").alias("weight"), pick(STARTS).alias("start"), (MOST_REPEATS * F.col("source_size")).alias("most"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"words": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    rows = rows.withColumns({"most_before": F.coalesce(F.sum("most").over(before), F.lit(0)), "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    rate = (F.col("words") - F.col("most_before")) / (F.col("weights") - F.col("weights_before"))
    rows = rows.withColumn("limited", F.col("most") <= rate * F.col("weight"))
    spent = lambda c: F.coalesce(F.sum(F.when(F.col("limited"), F.col(c))).over(everything), F.lit(0))
    left = (F.col("words") - spent("most")) / (F.col("weights") - spent("weight"))
    return rows.select("source", "source_size", "number", "weight", "start", F.when(F.col("limited"), F.col("most").cast("double")).otherwise(left * F.col("weight")).alias("target"))


def position(place: Column, target: Column, start: Column) -> Column:
    """The time in [0, 1] at which a source's demand reaches ``place`` words.

    The weight runs from ``start`` to ``2 - start`` of its mean, the demand is ``start * t + (1 - start) * t ** 2`` of
    the target, and this is its inverse.
    """
    share = F.try_divide(place, target)
    return 2 * share / (start + F.sqrt(start * start + 4 * (1 - start) * share))


def placed(rows: DataFrame) -> DataFrame:
    """``rows(id, source, size, tie, ...)`` with ``source_size``, ``target``, ``taken``, ``copies`` and ``position``.

    ``copies`` is an array of (turn, words, position), one entry for each time the document is taken. A document is taken
    as a whole or not at all; at the end of a source's target, by what comes nearer to it.
    """
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("order", order).withColumn("lead", F.conv(F.substring("order", 1, 8), 16, 10).cast("long"))
    facts = stored(rows.select("source", "size", "lead"), "mix-sizes")
    sources = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    known = stored(targets(sources.select("source", "source_size")), "mix-targets")
    most = facts.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = min(32, max(0, (most // CHUNK).bit_length()))
    chunk = F.shiftright("lead", 32 - bits)
    sums = stored(facts.groupBy("source", chunk.alias("chunk")).agg(F.sum("size").alias("chunk_size")), "mix-chunks")
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("carried"))
    sums = stored(sums.join(known, sums["source"].eqNullSafe(known["source"])).drop(known["source"]).withColumnsRenamed({"source": "of", "chunk": "nth"}), "mix-chunks")
    rows = rows.withColumn("chunk", chunk)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("nth")))
    within = Window.partitionBy("number", "chunk").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.col("carried") + F.sum("size").over(within) - F.col("size"))
    words = F.floor(F.col("target") + 0.5).cast("long")
    turns = []
    for turn in range(MOST_REPEATS):
        at = F.col("place") + turn * F.col("source_size")
        turns.append(F.struct(F.lit(turn).alias("turn"), F.when(2 * (words - at) > F.col("size"), F.col("size")).otherwise(0).alias("words"), position(at, F.col("target"), F.col("start")).alias("position")))
    copies = F.filter(F.array(*turns), lambda c: c["words"] > 0)
    rows = rows.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"]))
    return rows.withColumn("position", F.get("copies.position", F.lit(0)))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, ``n_copies``, ``position``.

    A text without words (null, empty) is never taken (``position`` is null then); a source without words has target 0.
    Null sources are one source, the last. A null id is ordered as the empty text. Rows that repeat id and text are taken one after the other, each on its own.
    The order of documents depends on ids and texts only, so reruns agree. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(whole(text)).alias("tie"))
    out = placed(stored(rows, "mix-rows"))
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), F.round("position", 9).alias("position"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: ``docs``, all columns, a row for each copy taken, range-sorted by training position.

    Texts are whole. Rows without words are not taken, and a table without words gives no rows. Columns may have any names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(whole(text)).alias("tie"), F.struct(*columns).alias("row"))
    copies = placed(rows).select("row", F.explode("copies").alias("copy"), "order")
    ready = copies.select("row", F.col("copy.position").alias("position"), "order")
    ready = ready.repartitionByRange("position", "order").sortWithinPartitions("position", "order")
    return ready.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

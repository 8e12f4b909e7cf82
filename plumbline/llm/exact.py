"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its digests, sorted, each with its best row. In each round ``FAN_IN`` neighbouring
runs are merged, so ``log(partitions)`` rounds leave one run. A round deals its rows out by (run, digest): even the
last one is spread over all tasks, and a digest has at most ``FAN_IN`` rows to merge however many copies there are.
The verdicts go back down the same tree, so no join meets the copies of a text in one key either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import whole
from plumbline.session import stored

#: Runs merged at once are two to the power of this.
FAN_IN_BITS = 4
#: A digest counts as verified where length and a second, unrelated hash agree too; else the texts stay apart.
VERIFIED = ["digest", "n_bytes", "second"]


def _marks(text: str) -> list[Column]:
    body = whole(text)
    return [F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).alias("n_bytes"), F.xxhash64(body).alias("second")]


def _merged(rows: DataFrame) -> DataFrame:
    """One row per run and verified digest: the best (largest) identifier and the number of copies."""
    return rows.groupBy("run", *VERIFIED).agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def _parents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run", F.shiftright("run", FAN_IN_BITS))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are. Of equal texts the largest id stays; a null id is the smallest. Rows that
    repeat both id and text count as copies, and exactly one of them is kept. Null texts equal the empty text.
    An empty table gives no rows; other columns are not read.
    """
    leaf = docs.select(F.col(id_column).alias("id"), *_marks(text), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))
    # Stored once: the run numbers and row numbers below are then fixed, whatever is recomputed later.
    leaf = stored(leaf.sortWithinPartitions("digest"), "digest-runs")
    last = leaf.agg(F.max("run")).first()[0] or 0
    levels = [stored(_merged(leaf.select("run", *VERIFIED, F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("copies"))), "digest-merge")]
    while last > 0:
        last >>= FAN_IN_BITS
        levels.append(stored(_merged(_parents(levels[-1])), "digest-merge"))
    verdict = levels.pop()
    for level in reversed(levels):
        verdict = _handed_down(level.select("run", *VERIFIED), verdict, FAN_IN_BITS)
    rows = _handed_down(leaf, verdict, 0)
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))
    return rows.select(F.col("id").alias(id_column), F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _handed_down(rows: DataFrame, verdict: DataFrame, bits: int) -> DataFrame:
    """``rows`` with the verdict of their run's parent."""
    above = verdict.select(F.col("run").alias("parent"), *[F.col(c).alias(f"above_{c}") for c in VERIFIED], "best", "copies")
    same = (F.shiftright(F.col("run"), bits) == F.col("parent")) if bits else (F.col("run") == F.col("parent"))
    for c in VERIFIED:
        same = same & (F.col(c) == F.col(f"above_{c}"))
    return rows.join(above, same).drop("parent", *[f"above_{c}" for c in VERIFIED])


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: that with the largest id.

    Columns of any other name or type pass through, whatever they are called. Null texts equal the empty text, a null id is
    the smallest, and an empty table stays empty.
    """
    keepers = exact_groups(docs, id_column, text).filter("kept").select(F.col("keep_id").alias("keep_id"), F.unhex("text_sha256").alias("keep_digest"))
    packed = docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(whole(text), 256)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    # Rows that repeat id and text are next to each other after the join, which has sorted on the same two columns; which
    # of them stays depends on their other columns only (on none that holds a map, which has no hash).
    others = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.xxhash64(*others)))
    return packed.join(keepers, same, "left_semi").withColumn("nth", nth).filter("nth = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

"""Near duplicates by a signature-coordinate inverted join.

A document's set of 5-word shingles has a MinHash signature. Documents are posted under the values of their signature's
coordinates; two that agree in at least ``MATCHES`` of ``COORDINATES`` are candidates, confirmed on their full sets.

* Prefix: values are ordered from rare to common. Two signatures with ``MATCHES`` values in common share one among the
  first ``COORDINATES - MATCHES + 1`` of either, so only those are posted, and common passages are never merged.
* Skip: the long lists that are left out are not merged but probed: the collisions of a candidate pair are counted on
  the two signatures.
* A true pair (similarity 0.75) agrees in fewer than ``MATCHES`` = 27 of 64 coordinates once in about 10 ** 8 pairs.

Only components are asked for, so a list is never expanded into all its pairs. Equal sets are one class. Every list
pairs its members with a few pivots of the list; links found join components, and lists that lie in one
component are done. The lists that still span components are settled exactly: their classes are joined
by a prefix filter on the full sets, each with classes of larger components only. No link between components is lost, and
a class that differs from a large group in many shingles of its own meets none of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.components import components
from plumbline.llm.text import lower_words, mixed, whole
from plumbline.session import stored

SHINGLE = 5
COORDINATES, MATCHES = 64, 27
PREFIX = COORDINATES - MATCHES + 1
PIVOTS = 3
#: Set sizes within this factor are looked up together.
SIZE_STEP = 1.05
#: Words whose hash a worker remembers.
REMEMBERED = 100_000
_STEPS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

_FACTORS = mixed(_SEEDS) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_HASHES = _Hashes()


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; with fewer words, of the whole sequence."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(codes) - SHINGLE + 1)
    total = np.full(n, min(len(codes), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(codes))):
        total = mixed(total + codes[k : k + n] * _STEPS[k])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``COORDINATES`` hash functions over a set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):  # a block of values of all coordinates stays in the processor's cache
        x = (hashes[None, start : start + 512] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    return mixed(least ^ _SEEDS)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


_SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("signature", T.ArrayType(T.LongType()))])


def _longs(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in rows)])))


@F.arrow_udf(_SIGNED)
def signed(texts: pa.Array) -> pa.Array:
    sets = [shingle_hashes(x) for x in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), _longs([signature(s) if len(s) else s for s in sets])],
        ["n", "class", "signature"],
    )


_SETS = T.StructType([T.StructField("cid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, class, text) -> (cid, shingles), for texts that are of the class."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [(cid, s) for cid, kind, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if fingerprint(s := shingle_hashes(text)) == kind]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), _longs([s for _, s in found])], ["cid", "shingles"])


def _near_sizes(a: str, b: str) -> Column:
    """Sets whose sizes alone do not rule out the similarity."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id that links lead to, and ``kept`` says that it is the row's own. A text without words (null, empty, blanks) is linked
    with nothing. Rows with equal sets are linked; rows that repeat an id are judged by their own texts. A null id is
    larger than any other. An empty table gives no rows. Other columns are not read.
    """
    body = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    rows = stored(body.select("id", signed("text").alias("s")).select("id", "s.*"), "signatures")
    classes = rows.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    links = _links(body, classes)
    labels = components(links.select("a", "b"))
    per_class = classes.join(labels, classes["cid"] == labels["node"], "left").select("class", "cid", "id", F.coalesce("root", "cid").alias("root"))
    least = per_class.groupBy("root").agg(F.min("id").alias("component_id"))
    per_class = stored(per_class.join(least, "root").select("class", "component_id"), "class-labels")
    out = rows.select("id", "n", "class").join(per_class, "class", "left")
    label = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), label.alias("component_id"), label.eqNullSafe(F.col("id")).alias("kept"))


def _links(body: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links ``a < b`` between classes, enough of them to connect every component."""
    lists = _postings(classes)
    signatures = classes.select("cid", "signature")
    members = lists.select("cid").distinct()
    sets = classes.join(members, "cid").select("cid", "class", "id")
    named = body.join(sets, body["id"].eqNullSafe(sets["id"])).select("cid", "class", "text")
    sets = stored(named.mapInArrow(_sets, _SETS), "shingle-sets").dropDuplicates(["cid"])
    sets = stored(sets, "shingle-sets")
    lists = lists.withColumn("label", F.col("cid"))
    links = stored(_confirmed(_pivot_pairs(lists), signatures, sets), "links")
    labels = stored(components(links).select(F.col("node").alias("cid"), "root"), "labels")
    labelled = stored(lists.join(labels, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root"), "labelled-lists")
    spanning = labelled.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("element")
    lists = stored(labelled.join(stored(spanning, "open-lists"), "element"), "open-lists")
    return stored(links.union(_confirmed(_rest_pairs(lists, sets), signatures, sets)).distinct(), "links")


def _postings(classes: DataFrame) -> DataFrame:
    """(element, cid, n, alone): each class under the rarest values of its signature, where another class is too.

    ``alone`` is how many of its values no other class has.
    """
    posts = stored(classes.select("cid", "n", F.explode("signature").alias("element")), "postings")
    shared = posts.groupBy("element").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    posts = posts.join(stored(shared, "shared-values"), "element")
    # Values of one class alone are the rarest: they fill the front of the prefix and are posted nowhere.
    of_class = Window.partitionBy("cid")
    ranked = posts.withColumn("rank", F.row_number().over(of_class.orderBy("df", "element"))).withColumn("alone", COORDINATES - F.count(F.lit(1)).over(of_class))
    prefix = stored(ranked.filter(F.col("rank") + F.col("alone") <= PREFIX).select("element", "cid", "n", "alone"), "prefixes")
    met = prefix.groupBy("element").agg(F.count(F.lit(1)).alias("posted")).filter("posted > 1").select("element")
    return stored(prefix.join(stored(met, "shared-values"), "element"), "prefixes")


def _pivot_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's pivots.

    A pivot has as few values of its own as any in the list: it is near the middle of its group, where one link joins
    most members. Among those, an order that all lists share lets few pivots serve many lists.
    """
    first = [F.min(F.struct("alone", F.xxhash64("cid", F.lit(k)).alias("order"), "cid", "n")) for k in range(PIVOTS)]
    pivots = stored(lists.groupBy("element").agg(F.array(*first).alias("pivots")), "pivots")
    pairs = lists.join(pivots, "element").select("cid", "n", F.explode("pivots").alias("p")).filter("cid <> p.cid").filter(_near_sizes("n", "p.n"))
    return pairs.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b"))


def _least_common(x: Column, y: Column) -> Column:
    """How many shingles sets of these sizes have in common if they are similar: 100 c >= 75 (x + y - c)."""
    return F.ceil(3 * (x + y) / 7)


def _rest_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components that can be links, by an exact prefix filter on the full sets of the lists' classes.

    Shingles are ordered from rare to common among these classes. Similar sets x and y have one in common among the first
    ``x - common + 1`` of x and ``y - common + 1`` of y. A class looks up the sizes that a partner can have, so that it is
    posted under few shingles for each, and meets only classes of components that come later by size.
    """
    members = lists.select("cid", "n", "label").distinct()
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = stored(members.join(sizes, "label").select("cid", F.col("n").cast("int").alias("n"), F.struct("size", "label").alias("component")), "rest-classes")
    placed = stored(lists.select("element", "cid").join(members, "cid"), "rest-lists")
    last = placed.groupBy("element").agg(F.max("component").alias("last"))
    seekers = stored(placed.join(stored(last, "rest-lists"), "element").filter("component < last").select("cid").distinct(), "rest-seekers")
    shingles = stored(sets.join(members, "cid").select("cid", "n", "component", F.explode("shingles").alias("shingle")), "rest-shingles")
    common = stored(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "rest-counts")
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("df", "shingle"))
    ranked = shingles.join(common, "shingle").withColumn("rank", nth).filter("df > 1 and 4 * (rank - 1) <= n")
    ranked = stored(ranked.select("cid", "n", "component", "shingle", "rank"), "rest-prefixes")
    bucket = lambda size: F.floor(F.log(size) / float(np.log(SIZE_STEP))).cast("int")
    least = lambda b: F.floor(F.pow(F.lit(SIZE_STEP), b) * (1 - 1e-9))
    sought = ranked.join(seekers, "cid").select(F.col("cid").alias("o_cid"), F.col("n").alias("o_n"), F.col("component").alias("o_component"), "shingle", F.col("rank").alias("o_rank"))
    sought = sought.withColumn("bucket", F.explode(F.sequence(bucket(F.ceil(0.75 * F.col("o_n"))), bucket(F.ceil(F.col("o_n") / 0.75)))))
    sought = sought.filter(F.col("o_rank") <= F.col("o_n") - _least_common(F.col("o_n"), F.greatest(least(F.col("bucket")), F.ceil(0.75 * F.col("o_n")))) + 1)
    found = ranked.withColumn("bucket", bucket(F.col("n"))).join(sought, ["shingle", "bucket"])
    common_least = _least_common(F.col("n"), F.col("o_n"))
    found = found.filter(F.col("o_component") < F.col("component")).filter(_near_sizes("n", "o_n"))
    found = found.filter((F.col("rank") <= F.col("n") - common_least + 1) & (F.col("o_rank") <= F.col("o_n") - common_least + 1))
    return found.select(F.least("cid", "o_cid").alias("a"), F.greatest("cid", "o_cid").alias("b"))


def _confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that agree in enough coordinates, then in enough shingles."""
    pairs = stored(pairs.distinct(), "candidates")
    pairs = pairs.join(signatures.select(F.col("cid").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("cid").alias("b"), F.col("signature").alias("sb")), "b")
    matches = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    pairs = stored(pairs.filter(matches >= MATCHES).select("a", "b"), "candidates")
    pairs = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.filter(100 * both >= 75 * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: that with the smallest id.

    Rows that repeat the id of a kept document with a text of the same group are all kept; drop exact copies first.
    """
    dropped = near_groups(docs, id_column, text).filter("not kept").select(F.col(id_column).alias("dropped_id"), F.lit(True).alias("dropped")).distinct()
    packed = docs.select(F.col(id_column).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(dropped, F.col("id").eqNullSafe(F.col("dropped_id")), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

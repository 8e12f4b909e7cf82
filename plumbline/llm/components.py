"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges(a, b)``; the root is the smallest node that can be reached.

    Each round is a written table; rounds grow with the logarithm of a component's width. Neighbours are only reduced to
    their minimum, which combines before the shuffle, and a hub with many neighbours is one side of an ordinary join.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen: tuple = ()
    while True:
        edges = stored(_small_star(_large_star(edges)), "star-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen = now


def _least(sides: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours."""
    return sides.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour."""
    sides = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    return sides.filter("y > x").join(_least(sides), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    sides = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = _least(sides)
    moved = sides.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("x", "m")).filter("u <> v").distinct()

"""Lineage graphs as edge tables: bounded neighbourhoods, closures, name resolution and overlays.

A walk is a loop of joins between the frontier and the edges. Each step keeps only unseen nodes, made
distinct on the map side, and is written as a table of the shared folder, so a lost executor costs one
step, the plan never grows with the depth, and a frontier is broadcast exactly while its stored size is
small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored



def both_ways(edges: DataFrame) -> DataFrame:
    """Edges readable from either end."""
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def walk(arcs: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """``(id, depth)`` of the nodes reachable from ``start(id)`` over ``source → target``, within ``depth`` steps.

    Without a depth the walk goes on until a step finds nothing new.
    """
    arcs = stored(arcs.select("source", "target"), "arcs") if depth is None or depth > 1 else arcs
    reached = stored(start.select("id").distinct().withColumn("depth", F.lit(0)), "step")
    frontier, step = reached, 0
    while depth is None or step < depth:
        step += 1
        found = (
            frontier.select(F.col("id").alias("source"))
            .join(arcs, "source")
            .select(F.col("target").alias("id"))
            .distinct()
            .join(reached.select("id"), "id", "left_anti")
            .withColumn("depth", F.lit(step))
        )
        frontier = stored(found, "step")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def subgraph(edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` undirected steps and the edges among them."""
    if depth < 1:
        raise ValueError("a subgraph needs a depth of 1 at least")
    nodes = walk(both_ways(edges), start, depth)
    return nodes, edges_among(edges, nodes)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = nodes.select("id")
    return edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(
        kept.withColumnRenamed("id", "target"), "target", "left_semi"
    ).select(*edges.columns)


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything fed, directly or not, by ``start``."""
    return walk(edges, start)


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything ``start`` is fed by."""
    return walk(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), start)


def table_of(column_id: Column) -> Column:
    """The table part of a ``table.column`` id."""
    return F.when(F.contains(column_id, F.lit(".")), F.regexp_extract(column_id, r"^(.*)\.[^.]*$", 1)).otherwise(column_id)


def column_subgraph(column_edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns within ``depth`` steps, the tables that hold them and the column edges among them."""
    columns, kept = subgraph(column_edges, start, depth)
    tables = columns.groupBy(table_of(F.col("id")).alias("table_id")).agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("columns"))
    return columns, tables, kept


def resolve_references(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """Node of each ``(ref_schema, ref_name)``: the exact table, else the only table of that name, else external.

    Two equi-joins; bare names are counted once per name first.
    """
    tables = catalog.select(F.lower("schema_name").alias("_s"), F.lower("table_name").alias("_n"), "node_id").distinct()
    exact = tables.select("_s", "_n", F.col("node_id").alias("_exact"))
    lone = tables.groupBy("_n").agg(F.count(F.lit(1)).alias("_k"), F.min("node_id").alias("_lone")).filter(F.col("_k") == 1).drop("_k")
    refs = references.withColumn("_s", F.lower("ref_schema")).withColumn("_n", F.lower("ref_name"))
    joined = refs.join(exact, ["_s", "_n"], "left").join(lone, "_n", "left")
    external = F.when(F.col("ref_schema").isNull(), F.col("ref_name")).otherwise(F.concat_ws(".", "ref_schema", "ref_name"))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_lone").isNotNull(), "unique_name").otherwise("external")
    return joined.select(*references.columns, F.coalesce("_exact", "_lone", external).alias("node_id"), how.alias("resolved_by"))


def overlay(nodes: DataFrame, health: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Nodes with health and ownership."""
    joined = nodes.join(health, "dataset_id", "left").join(knowledge, "dataset_id", "left")
    return joined.select(
        *nodes.columns,
        F.coalesce("health", F.lit("unknown")).alias("health"),
        F.coalesce("failing_checks", F.lit(0)).cast("bigint").alias("failing_checks"),
        F.coalesce("open_exceptions", F.lit(0)).cast("bigint").alias("open_exceptions"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce("importance", F.lit("")).alias("importance"),
    )

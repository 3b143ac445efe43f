"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Everything is joins and aggregates over the edges: no group of neighbours is gathered in a task, and nothing but two
numbers comes to the driver. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


#: Edges in one task. Few edges are worked on by few tasks, so that a round leaves few files.
TASK_EDGES = 100_000


def _star(edges: DataFrame, both_ways: bool, tasks: int) -> DataFrame:
    """Large star (both_ways): every larger neighbour of u is linked to the smallest of u and its neighbours.
    Small star: u and every smaller neighbour are linked to the smallest of these."""
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    down = edges.select(a, b)
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).coalesce(tasks)
    joined = near.join(least, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node that can be reached.

    Loops and repeated edges do no harm; a row with a null is left out. No edges give no rows.
    """
    edges = cut_lineage(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    tasks = max(1, edges.count() // TASK_EDGES)
    edges, seen = edges.coalesce(tasks), None
    while True:
        edges = cut_lineage(_star(_star(edges, True, tasks), False, tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct().coalesce(tasks))

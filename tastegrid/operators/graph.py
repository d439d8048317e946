"""Iterative operators on graphs given as edges: connected components and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.runtime import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component of each node that an edge (a, b) names.

    Each round, a node takes the least root that a neighbour has, and then the root of its root, so that long chains
    halve; the rounds are cut by checkpoints and end when no root changes. Loops, repeated edges, and edges with a
    null end are no links.
    """
    ends = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    both = checkpointed(edges.where("a <> b").select(F.inline(F.array(*ends))).distinct())
    if both.isEmpty():
        return both.select("node", F.col("other").alias("root"))
    roots = checkpointed(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        seen = roots.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = roots.join(near, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = checkpointed(lower.join(jump, "root", "left").select("node", F.coalesce("further", "root").alias("root"), "was"))
        roots = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return roots


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, depth: what can be reached from the nodes of ``start`` over edges (a, b), breadth first.

    Each round joins the frontier with its edges and leaves out what was visited before; it ends with an empty
    frontier, so cycles do no harm. Nulls are no nodes.
    """
    links = edges.where("a is not null and b is not null").select("a", "b").distinct()
    visited = checkpointed(start.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = visited, 0
    while True:
        depth += 1
        met = links.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(met.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        visited = checkpointed(visited.union(frontier))

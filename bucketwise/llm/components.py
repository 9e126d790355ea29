"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is a join and a distinct over the edges, written to the shared folder, so a lost executor costs one round.
Edges of a hub are never gathered in one task: its least neighbour is an aggregate, and the join that hands it to the
neighbours is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from bucketwise.sources.scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u < v. Large: hang a node's greater neighbours on its least one; small: hang the lesser ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")
        return out.distinct()
    # node = the greater end, its neighbours the lesser ends
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, and their number and a sum of hashes, taken while they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    rows = materialize(edges.observe(seen, F.count("*").alias("n"), F.coalesce(total, F.lit(0)).alias("s")), "edges")
    return rows, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node reachable.

    ``edges``: longs ``u`` and ``v``; loops, repeats and either direction are fine.
    """
    now, seen = _written(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    )
    while seen[0]:
        then = seen
        now, seen = _written(_star(_star(now, large=True), large=False))
        if then == seen:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select("u", "u").toDF("node", "component")
    ).distinct()

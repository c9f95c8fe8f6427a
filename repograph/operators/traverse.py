"""Bounded traversals against the direction of edges, level by level.

A level is one join of the frontier with the edges and one aggregate, written, so
that lineage stays short and an empty frontier ends the loop. Only the frontier
moves; Spark broadcasts it while it is small and shuffles it when it isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators.tables import written


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, hops of the nodes from which a node of start (a column id) is reached in 1..depth steps.
    A start node is among them only if a cycle leads back to it."""
    edges = edges.select("src", "dst")
    frontier, levels = start.select("id"), []
    for hop in range(1, depth + 1):
        met = edges.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        for seen in levels:
            met = met.join(seen.select("id"), "id", "left_anti")
        frontier = written(met.select("id", F.lit(hop).alias("hops")), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = frontier.where("false") if not levels else levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def widest(edges: DataFrame, start: DataFrame, depth: int, most: int = 3) -> DataFrame:
    """id, votes: over all walks of at most depth steps to a start node, the greatest least vote of an
    edge (edges: src, dst, votes), at most `most`. Repeating a node never raises the least vote, so walks do."""
    edges = edges.select("src", "dst", F.least("votes", F.lit(most)).alias("votes"))
    frontier, levels = start.select("id", F.lit(most).alias("have")), []
    for _ in range(depth):
        met = edges.join(frontier.select(F.col("id").alias("dst"), "have"), "dst")
        frontier = written(
            met.groupBy(F.col("src").alias("id")).agg(F.max(F.least("votes", "have")).alias("have")), "level"
        )
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = frontier.where("false") if not levels else levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.groupBy("id").agg(F.max("have").alias("votes"))


def best_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, hops, conf, chain: one shortest path to the start node for each node, the most confident of
    them, then the least chain of ids from the start on. edges: src, dst, conf."""
    edges = edges.select("src", "dst", F.coalesce("conf", F.lit(1.0)).alias("conf"))
    edges = edges.groupBy("src", "dst").agg(F.max("conf").alias("conf"))
    frontier = start.select("id", F.lit(1.0).alias("conf"), F.array("id").alias("chain"))
    levels, seen = [], [start.select("id")]
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("dst"), F.col("conf").alias("c"), "chain"), "dst")
        step = step.select(
            F.col("src").alias("id"), (F.col("conf") * F.col("c")).alias("conf"), F.concat("chain", F.array("src")).alias("chain")
        )
        for s in seen:
            step = step.join(s, "id", "left_anti")
        best = F.min_by(F.struct("conf", "chain"), F.struct(-F.round("conf", 6), "chain"))
        frontier = written(
            step.groupBy("id").agg(best.alias("v")).select("id", F.lit(hop).alias("hops"), "v.conf", "v.chain"), "level"
        )
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen.append(frontier.select("id"))
    out = frontier.where("false") if not levels else levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("id", "hops", "conf", "chain")

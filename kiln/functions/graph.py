"""Connected components of an edge table by hooking and pointer jumping.

Each round every root hooks to its neighbour (or itself) of smallest priority, a keyed hash that
changes with the round, so that more than half of the roots with edges go away in expectation
whatever the shape of the graph; pointers are then jumped to their ends, and edges are rewritten to
the remaining roots. Rounds, and the jumps inside one, grow with the logarithm of the node count, not with the
diameter. Each step is saved in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.session import saved


def _jump(parent: DataFrame) -> DataFrame:
    """(node, root) from pointers (node, root): followed to their ends, doubling each time."""
    while True:
        ahead = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        longer = saved(parent.join(ahead, parent["root"] == ahead["_n"]).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("_moved")))
        if not longer.where("_moved").limit(1).count():
            return longer.drop("_moved")
        parent = longer.drop("_moved")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every row of ``nodes`` (column node): nodes with a path of ``edges`` (columns a, b)
    between them share a root, which is one of them. Edges may repeat, point both ways or be loops;
    their ends must be nodes."""
    found = saved(nodes.select("node").distinct().withColumn("root", F.col("node")))
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turn = 0
    while left.limit(1).count():
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("p"), F.col("b").alias("to"))).alias("best"))
        own = F.struct(F.xxhash64(F.lit(turn), "node").alias("p"), F.col("node").alias("to"))
        hooked = saved(best.select("node", F.least(F.col("best"), own)["to"].alias("root")))
        ends = _jump(hooked)
        to = ends.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        found = saved(found.join(to, found["root"] == to["_n"], "left").select("node", F.coalesce("_r", "root").alias("root")))
        moved = left.join(to, left["a"] == to["_n"]).select(F.col("_r").alias("a"), "b")
        moved = moved.join(to, moved["b"] == to["_n"]).select("a", F.col("_r").alias("b"))
        left = saved(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found

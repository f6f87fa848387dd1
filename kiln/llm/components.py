"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b); component is the smallest node.

    Each step joins links with one minimum per node, so no node's neighbours meet in one task
    (a hot node's rows are split by AQE); the number of rounds grows with the logarithm of the
    longest path. Rounds are saved, so a lost executor repeats one round at most. Self-links and
    repeated links are allowed; an empty table gives an empty table; null ends are dropped.
    """
    pairs = links.where("a is not null and b is not null")
    loops = pairs.where("a = b").select("a").distinct()
    edges = save(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "links")
    seen = before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.join(least, F.col("u") == F.col("k")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        edges = save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        # equal sums ask for the full comparison: as many distinct links, and none that is new
        if seen is not None and now == seen and not edges.join(before, ["u", "v"], "left_anti").limit(1).count():
            break
        seen, before = now, edges
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            .unionByName(loops.select(F.col("a").alias("node"), F.col("a").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")))

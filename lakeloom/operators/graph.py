"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation and a join over the edges (Kiveris et al., "Connected components in MapReduce
and beyond"). Steps are written to the shared folder, so lineage stays short and a lost executor costs
one step; the table of a finished step goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.formats import removed, stored

STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node it is connected with, for nodes of edges (a, b) between different nodes."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(STEPS):
        # Done when every node has one edge, to a node that has none of its own.
        above = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        chained = e.select(F.col("v").alias("u")).join(above, "u", "left_semi")
        if above.filter("n > 1").isEmpty() and chained.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        e, before = stored(small, "edges"), e
        removed(before)
    raise RuntimeError(f"components did not settle in {STEPS} steps")

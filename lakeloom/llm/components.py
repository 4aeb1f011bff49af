"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges (Kiveris et al., "Connected components in
MapReduce and beyond"); a node of many edges is pre-aggregated and its join can be split. Every
step is written to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dropped, written

STEPS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node it is connected with), for the nodes of edges between different nodes."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e = written(e, "edges")
    for _ in range(STEPS):
        # Settled: each node has one edge, to a node that has none itself.
        many = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        chained = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if many.isEmpty() and chained.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        e, before = written(small.distinct(), "edges"), e
        dropped(before)
    raise RuntimeError(f"components did not settle in {STEPS} steps")

"""Connected components over edges of longs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges (a, b). Nodes without an edge are not in it.

    Each step is an aggregate with partial sums and a join that can be split, so no node's neighbours meet in
    one task; the number of steps grows with the logarithm of the longest path.
    """
    own = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        own = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        # every node points at one smaller node and no target points on: the stars are the components
        now = own.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("y")).first()
        if before == now:
            break
        before = now
    labels = own.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())

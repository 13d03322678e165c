"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns id and component (the smallest id reachable) of every vertex of `edges` (a, b) but the components'
    own smallest. Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left, after a
    number of rounds that follows the logarithm of the longest path. A vertex's least neighbour comes from a partial
    aggregation, and the join with it is one that Spark can split, so a vertex with very many edges is no burden.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = scratch.table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.table(large.where("u != v").distinct(), "large")
        s = least(large)
        small = large.join(s, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v")))
        after = scratch.table(small.where("u != v").distinct(), "small")
        scratch.drop(large, now)
        now = after
        # done when each vertex has one edge, to a vertex that has none: stars around the smallest vertices
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))

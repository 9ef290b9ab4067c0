"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.scratch import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """A row ``(node, label)`` for each node of ``edges(a, b)``; the label is the component's least node.

    Each round is a grouped minimum and a join; hot nodes are combined before the shuffle, rounds grow with the logarithm of the longest path, and
    every round is written to the shared folder. It raises if labels don't settle.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        nbr = both(now)
        low = nbr.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = nbr.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            ends = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node").union(ends)
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components by alternating large-star and small-star steps, as joins and aggregates on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_DIGESTS, discard, keyed_join, written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the least node of its component.

    Each step keeps at most as many edges as before and no step gathers a node's neighbours in one row: what a node's
    neighbourhood gives is an aggregate that combines before the shuffle, written and then joined, so that a node with very many
    neighbours is a skewed key of a plain join, which adaptive execution splits (below BROADCAST_DIGESTS nodes nothing is
    shuffled for it). Rounds grow with the logarithm of a component's diameter. An edge from a node to itself names a node
    without links.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")  # a >= b
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour of a node is linked to the least of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("root")).withColumn("root", F.least("root", "a")), "least")
        large = written(keyed_join(both.where("b >= a"), least, "a", "inner", BROADCAST_DIGESTS).select(F.col("b").alias("a"), F.col("root").alias("b")), "large")
        # small star: a node and its smaller neighbours are linked to the least of those
        low = written(large.groupBy("a").agg(F.min("b").alias("root")), "low")
        rest = keyed_join(large, low, "a", "inner", BROADCAST_DIGESTS).where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        before, now = now, written(rest.union(low.select("a", F.col("root").alias("b"))), "edges")
        discard(before, least, large, low)
        # settled: every node has one edge, to a node that has none but to itself
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")), F.struct(F.col("b").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
        degrees = now.where("a <> b").select(F.inline(ends)).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
        if not degrees.agg(F.count_if((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("downs") > 0))).first()[0]:
            return now.union(now.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import hot_keys, salted_join
from gridloom.llm.storage import stored


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all nodes
    of ``edges`` (``a``, ``b``) that aren't their own root.

    Every round is two aggregations and joins over the edges and ends in a
    written table; rounds grow with the logarithm of the component size.  The
    edges of a node with very many are dealt over parts.  Self-loops and nulls
    are ignored.  More than ``rounds`` rounds are an error.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        either = stored(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "large")
        least = either.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = salted_join(either.where(F.col("b") > F.col("a")), least.select("a", "m"), "a", hot_keys(least, "a", "n", 2 * mark[0]), F.col("b"))
        large = met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, point to the smallest of them
        large = stored(large.where(F.col("a") != F.col("b")), "small")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        met = salted_join(large, lowest.select("a", "m"), "a", hot_keys(lowest, "a", "n", 2 * mark[0]), F.col("b"))
        small = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"components are unfinished after {rounds} rounds")

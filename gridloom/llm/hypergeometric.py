"""Exact multivariate-hypergeometric splits as DataFrame expressions.

A matrix of counts with given row sums (leaf sizes) and column sums (quotas),
distributed as if all items had been shuffled, is drawn by halving the leaves
again and again: each node splits its quotas between its halves by univariate
hypergeometric draws, one per quota.  Draws invert the distribution function
at a uniform number hashed from seed, level, node and quota, so a recomputed
task draws the same counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import unit

#: Half width of the inverted range in standard deviations; what lies beyond
#: has less weight than a double's last bit.
REACH = 12.0


def draw(total: Column, good: Column, take: Column, u: Column) -> Column:
    """How many of ``take`` items drawn from ``total`` are among ``good``."""
    low = F.greatest(F.lit(0).cast("long"), take - (total - good))
    high = F.least(take, good)
    t, g, m = total.cast("double"), good.cast("double"), take.cast("double")
    safe = F.greatest(t, F.lit(2.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), m * (g / safe) * (1 - g / safe) * (t - m) / (safe - 1)))
    mode = F.floor((m + 1) * (g + 1) / (t + 2)).cast("long")
    width = F.ceil(spread * REACH).cast("long") + 10
    first = F.greatest(low, F.least(mode, high) - width)
    last = F.least(high, F.greatest(mode, low) + width)
    steps = F.sequence(first, last)

    def after(p: Column, x: Column) -> Column:
        return p * ((m - x) * (g - x)) / ((x + 1) * (t - g - m + x + 1))

    one, zero = F.lit(1.0), F.lit(0.0)
    mass = F.aggregate(
        steps,
        F.struct(one.alias("p"), zero.alias("s")),
        lambda a, x: F.struct(after(a["p"], x.cast("double")).alias("p"), (a["s"] + a["p"]).alias("s")),
    )["s"]
    found = F.transform(F.array(u * mass), lambda goal: _passed(steps, after, goal))[0]
    return F.when(high <= low, low).otherwise(F.least(last, first + found))


def _passed(steps: Column, after, goal: Column) -> Column:
    """How many steps it takes until the running mass exceeds ``goal``."""
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("passed")),
        lambda a, x: F.struct(
            after(a["p"], x.cast("double")).alias("p"),
            (a["s"] + a["p"]).alias("s"),
            (a["passed"] + F.when(a["s"] + a["p"] <= goal, 1).otherwise(0)).cast("long").alias("passed"),
        ),
    )["passed"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def split_tree(root: DataFrame, leaves: int, seed: int, spread_from: int = 6) -> DataFrame:
    """The matrix of ``root``'s one row: ``sizes`` array<long> of ``leaves``
    leaf sizes and ``quotas`` array<long>, with equal sums.

    Returns one row per leaf: ``leaf`` int, ``counts`` array<long> (one count
    for each quota).  Below level ``spread_from`` nodes are dealt over tasks.
    """
    levels = max(0, math.ceil(math.log2(leaves))) if leaves > 1 else 0
    pad = (1 << levels) - leaves
    zero = F.lit(0).cast("long")
    nodes = root.select(
        F.lit(0).alias("node"),
        F.concat(F.col("sizes"), F.array_repeat(zero, pad)).alias("sizes"),
        F.col("quotas"),
    )
    for level in range(levels):
        half = 1 << (levels - level - 1)
        left, right = F.slice("sizes", 1, half), F.slice("sizes", half + 1, half)
        drawn = F.aggregate(
            F.sequence(F.lit(1), F.size("quotas")),
            F.struct(_sum(left).alias("good"), _sum(F.col("sizes")).alias("total"), F.array().cast("array<bigint>").alias("out")),
            lambda a, k: _step(a, k, level, seed),
        )["out"]
        nodes = nodes.where(F.size("quotas") > 0).select("node", left.alias("left"), right.alias("right"), "quotas", drawn.alias("drawn"))
        rest = F.zip_with("quotas", "drawn", lambda q, d: q - d)
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("sizes"), F.col("drawn").alias("quotas")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("sizes"), rest.alias("quotas")),
                )
            ).alias("n")
        ).select("n.*")
        if level == spread_from:
            nodes = nodes.repartition(F.col("node"))
    return nodes.where(F.col("node") < leaves).select(F.col("node").alias("leaf"), F.col("quotas").alias("counts"))


def _step(a: Column, k: Column, level: int, seed: int) -> Column:
    quota = F.element_at("quotas", k)
    u = unit(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), k))
    return F.transform(
        F.array(draw(a["total"], a["good"], quota, u)),
        lambda d: F.struct((a["good"] - d).alias("good"), (a["total"] - quota).alias("total"), F.concat(a["out"], F.array(d)).alias("out")),
    )[0]


def running(values: Column) -> Column:
    """Inclusive running sums of an array<long>."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out")),
    )["out"]

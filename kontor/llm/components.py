"""Connected components of links, and joins with a small side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import Staged

#: Numbers up to which a side is broadcast (16 MB); beyond it is shuffled.
BROADCAST_NUMBERS = 2_000_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a written table of numbers, with a broadcast hint if its counted rows allow
    it; any larger one is left to a shuffle join."""
    most = BROADCAST_NUMBERS // len(df.columns)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("mv")).withColumnRenamed("u", "w")
    return (edges.join(least, F.col("u") == F.col("w"))
            .select("u", "v", F.least("u", "mv").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Large-star and small-star steps alternate until the links form stars around
    the least nodes; each step is a grouped minimum and a join, and each round is
    a written table.  Self links and repeated links do no harm.
    """
    staged = Staged(links.sparkSession, "components")
    now = staged.write(links.filter(F.col("a") != F.col("b"))
                       .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_least_neighbour(both).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")).distinct())
        low = _least_neighbour(large)              # u > v holds for every link here
        small = (low.filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = staged.write(small, "round")
        staged.drop(now)
        now = new
        seen = now.agg(F.count(F.lit(1)).alias("n"),
                       F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))

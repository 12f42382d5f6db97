"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.shared import cut, forget


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and of all v that u has. Counts combine before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


#: Ends of more pairs than this don't meet in one task; they are so few that they are sent to all.
CROWD = 10_000


def _large_star(pairs: DataFrame, n: int) -> DataFrame:
    """(u, v) of ``pairs`` (u, v), u > v, with the least of what v has instead of v; ``n`` pairs at most. What is above a node
    isn't less than it, so the pairs alone tell: a node without any below it stays."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    moved = lambda rows, below: rows.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    if n <= CROWD:
        return moved(pairs, least).distinct()
    crowded = cut(pairs.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("v"))
    if crowded.isEmpty():
        return moved(pairs, least).distinct()
    below = cut(least.join(F.broadcast(crowded), "v", "left_semi"))
    few = moved(pairs.join(F.broadcast(crowded), "v", "left_anti"), least)
    return few.unionByName(moved(pairs.join(F.broadcast(crowded), "v", "left_semi"), F.broadcast(below))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Map every node of the undirected ``links`` to the least node it can reach.

    Returns (node, component). Self links and repeated links change nothing; links with a null
    end are ignored; no links give no rows. Each round is checkpointed, so a lost executor
    costs one round at most, and the round before it is deleted. Rounds grow with the logarithm of the longest path.
    """
    pairs = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before, n = None, pairs.count()
    while True:
        large = _large_star(pairs, n)
        met = _with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
        old, pairs = pairs, cut(small.where("u != v").distinct())
        forget(old)
        state = pairs.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before, n = state, state.n
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

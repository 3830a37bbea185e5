"""Connected components of a table of links, by tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import common


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node that links reach.

    Each round, large nodes point at the smallest neighbour and smaller neighbours
    are linked to it in their stead (alternating large-star and small-star); links
    are pre-aggregated and no neighbourhood is collected, so hubs don't matter. The
    rounds that it takes grow with the logarithm of the longest path; more than
    `rounds` of them raise a RuntimeError.
    """
    now = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # large-star: greater neighbours of a node go to the least of its neighbourhood
        least = common.written(least, "cc-least")
        large = common.join_hot(both, least, "a", "n", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.written(large, "cc-large")
        # small-star: a node and its smaller neighbours go to the least of these
        small = common.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc-small")
        met = common.join_hot(large, small, "a", "n", "b")
        moved = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        moved = common.written(moved, "cc-edges")
        changed = moved.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(moved, ["a", "b"], "left_anti").isEmpty()
        common.dropped(now, least, large, small)
        now = moved
        if changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return common.written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops), "cc-roots")

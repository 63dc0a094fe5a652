"""Connected components of a graph of links, without one task for any node's links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _minimum(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Smallest neighbour of each ``key``, itself included; combined before the shuffle, so stars cost little."""
    return edges.groupBy(key).agg(F.least(F.col(key), F.min(other)).alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for each node of ``links(a, b)``; the two are of one type.

    Alternates two steps until nothing changes: each node ties its larger neighbours to its least neighbour, then
    its smaller ones. Edges are written after each round, so a lost executor costs one round; the number of rounds
    grows with the logarithm of a component's width. A node's neighbours are only joined and min-aggregated,
    never gathered. NULL ends and loops are left out.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high > low").distinct(), "edges"
    )  # high > low in each row
    while True:
        both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
        tied = both.join(_minimum(both, "u", "v"), "u").filter("v > u").select(F.col("v").alias("high"), F.col("least").alias("low")).filter("high > low").distinct()
        large = written(tied, "edges")
        least = _minimum(large, "high", "low")
        joined = large.join(least, "high")
        small = joined.select(F.greatest("low", "least").alias("high"), F.least("low", "least").alias("low")).filter("high > low")
        own = least.select("high", F.col("least").alias("low"))
        after = written(small.unionByName(own).distinct(), "edges")
        # done when every node hangs on one smaller node, and that one on none
        state = after.agg(F.count("*").alias("n"), F.countDistinct("high").alias("highs")).first()
        if state.n == state.highs and after.join(after.select(F.col("low").alias("high")).distinct(), "high", "left_semi").isEmpty():
            break
        edges = after
    return after.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        after.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )

"""Connected components of a link table, by alternating large-star / small-star rounds.

Every round is two group-by-minimum aggregates (combined on the map side, so
a hub with a third of all links sends one row per map task) and joins on the
node.  Links are written to the shared folder after each round; only the
count of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)`` (longs, any order, repeats and loops allowed) -> ``(node, component)``.

    ``component`` is the smallest node reachable.  Nodes without a link to
    another node do not appear; an empty table gives an empty result.
    """
    edges = scratch.save(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour points at the least of the neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself point at the least smaller one
        low = _least_neighbour(large)
        small = (
            large.join(low, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.save(small, "links")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(
            after, ["u", "v"], "left_anti"
        ).limit(1).count()
        scratch.drop(edges)
        edges = after
        if not changed:
            break
    # a fixed point is a set of stars: every node but the centre points at the centre
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

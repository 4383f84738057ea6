"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearby_engine.llm.storage import stored


def _joined_to_least(edges: DataFrame) -> DataFrame:
    """u, v, m: m the least neighbour of u. The least are written first, so that a node with a huge number of links is
    met by a small table or split by adaptive execution."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has a link; from columns a, b of any ordered type.

    Every round cuts its lineage. Rounds grow with the logarithm of the size; the end is seen from a count and a checksum
    of the edges, so no link ever reaches the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Every larger neighbour is tied to the least of the neighbourhood.
        large = _joined_to_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        # Every smaller neighbour, and the node itself, is tied to the least of them.
        small = _joined_to_least(large)
        tied = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        edges = stored(small.select(tied.alias("e")).select("e.*").where("u <> v").distinct())

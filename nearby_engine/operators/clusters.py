"""Map clusters of offices: k-means over a circle and grid cells over a viewport."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions.geo import in_viewport, mercator_cell_x, mercator_cell_y
from nearby_engine.operators.ranking import numbered
from nearby_engine.operators.search import Tables, matching_offices
from nearby_engine.session import cut

DEFAULT_CLUSTERS = 20


def cluster_kmeans(
    t: Tables, lat: float, lng: float, radius_m: float, k: int = DEFAULT_CLUSTERS, seed: int = 42
) -> DataFrame:
    """Count and centroid per k-means cluster of the offices in the circle, largest first.

    Offices at the same point are one row with their number as its weight. The circle is read once; the iterations and the
    centroids start from what was written.
    """
    if k < 1:
        raise ValueError("k must be positive")
    offices = matching_offices(t, lat, lng, radius_m).groupBy("lat", "lng").agg(F.count("*").alias("weight"))
    points = cut(offices)
    vectors = VectorAssembler(inputCols=["lng", "lat"], outputCol="features").transform(points)
    if vectors.isEmpty():
        placed = points.withColumn("cluster_id", F.lit(0))
    else:
        means = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id", weightCol="weight")
        placed = means.fit(vectors).transform(vectors)
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
    return (
        placed.groupBy("cluster_id")
        .agg(F.sum("weight").alias("count"), mean("lat"), mean("lng"))
        .orderBy(F.desc("count"), "cluster_id")
    )


def cluster_grid(
    t: Tables,
    lat: float,
    lng: float,
    radius_m: float,
    west: float,
    south: float,
    east: float,
    north: float,
    zoom: int,
    query: str | None = None,
) -> DataFrame:
    """Count, mean point and bounding box per visible map cell, numbered from the largest."""
    box = in_viewport(F.col("lat"), F.col("lng"), west, south, east, north)
    seen = matching_offices(t, lat, lng, radius_m, query=query, viewport=box).select(
        "lat", "lng",
        mercator_cell_x(F.col("lng"), zoom).alias("cell_x"),
        mercator_cell_y(F.col("lat"), zoom).alias("cell_y"),
    )
    cells = seen.groupBy("cell_x", "cell_y").agg(
        F.count("*").alias("count"),
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.min("lng").alias("west"), F.min("lat").alias("south"),
        F.max("lng").alias("east"), F.max("lat").alias("north"),
    )
    ranked = numbered(cells, [-F.col("count"), F.col("cell_x")], [F.col("cell_y")], "cluster_id")
    return ranked.select(
        "cluster_id", "count", "lat", "lng", "west", "south", "east", "north"
    ).orderBy("cluster_id")


def cluster_totals(clusters: DataFrame) -> DataFrame:
    return clusters.agg(
        F.count("*").alias("cluster_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_points")
    )

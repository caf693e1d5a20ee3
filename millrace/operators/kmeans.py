"""k-means over a table of points.

The first k points by id seed the centroids; ties go to the lowest centroid; the loop ends when all centroids moved by
no more than the tolerance, or after max_iterations, and gives the assignment made before the last update. A centroid
without points stays where it is. Points are persisted for the loop and never moved; centroids are k rows and travel
with the plan: a round is a projection and a partial aggregation of k rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance


def labelled(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """points with label, the number of the nearest centroid. The centroids are one broadcast row."""
    row = points.sparkSession.createDataFrame([([(i, [float(x) for x in c]) for i, c in enumerate(centroids)],)], "mr_centroids array<struct<i:int,c:array<double>>>")
    scored = F.transform("mr_centroids", lambda c: F.struct(distance(F.col("coordinates"), c["c"]).alias("d"), c["i"].alias("i")))
    return points.crossJoin(F.broadcast(row)).withColumn("label", F.array_min(scored)["i"]).drop("mr_centroids")


def assign(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """id, label."""
    return labelled(points, centroids).select("id", "label")


def update(points: DataFrame, centroids: list[list[float]]) -> list[list[float]]:
    """Mean of each centroid's points, by place in the array: one row for each centroid reaches the driver."""
    means = [F.avg(F.get("coordinates", F.lit(at))) for at in range(len(centroids[0]))]
    moved = [list(c) for c in centroids]
    for row in labelled(points, centroids).groupBy("label").agg(F.array(*means).alias("mean")).collect():
        moved[row.label] = list(row.mean)
    return moved


def converged(old: list[list[float]], new: list[list[float]], tolerance: float) -> bool:
    return all(math.dist(a, b) <= tolerance for a, b in zip(old, new, strict=True))


def kmeans(points: DataFrame, k: int, max_iterations: int = 100, tolerance: float = 0.0) -> DataFrame:
    """id, label of points (id, coordinates array<double>)."""
    points.persist()
    try:
        centroids = [list(r.coordinates) for r in points.orderBy("id").limit(k).collect()]
        used = centroids
        for _ in range(max_iterations if centroids else 0):
            used, centroids = centroids, update(points, centroids)
            if converged(used, centroids, tolerance):
                break
    finally:
        points.unpersist()
    return assign(points, used)

"""Cluster assignment and event counts on streams.

No operator of the inventory is a stream (a download that is cut after n records
is a limit). These are the ones that carry over to streams as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.vector import cosine


def assign_stream(vectors: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """J15 on a stream: each arriving vector's nearest centroid; stateless. The centroids are the fitted model, given as values."""
    table = F.array(*[F.struct(F.lit(c).alias("cluster_id"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for c, v in centroids])
    scored = F.transform(table, lambda c: F.struct(cosine(vector, c["v"]).alias("score"), (-c["cluster_id"]).alias("neg")))
    return vectors.withColumn("_b", F.array_max(scored)).withColumns({"cluster_id": -F.col("_b.neg"), "score": F.col("_b.score")}).drop("_b")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts by type and tumbling window; events later than ``late`` are left out, so state stays bounded."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "total")

"""Citation graphs as edge lists.

Matrices are frames (i, j, w); they are never made dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.components import connected_components
from paperloom.operators.similarity import edge_weights


def symmetrise(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Every edge in both directions, a self-loop once; (i, j, w)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    there = edges.select(F.col("source").alias("i"), F.col("target").alias("j"), w.alias("w"))
    return there.unionByName(there.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def coalesce_edges(pairs: DataFrame) -> DataFrame:
    """One row for each (i, j), weights summed."""
    return pairs.groupBy("i", "j").agg(F.sum("w").alias("w"))


def citation_adjacency(edges: DataFrame, self_loops: str = "keep", nodes: DataFrame | None = None, binary: bool = False) -> DataFrame:
    """M6: symmetric adjacency (i, j, w).

    ``self_loops``: "keep" them, "drop" them, or "unit": drop them and set the
    diagonal of all ``nodes`` (of the edges' ends if None) to 1. Repeated and reciprocal
    edges add up (Q3) unless ``binary``.
    """
    if self_loops not in ("keep", "drop", "unit"):
        raise ValueError(f"self_loops is keep, drop or unit, not {self_loops!r}")
    kept = edges if self_loops == "keep" else edges.where("source <> target")
    out = coalesce_edges(symmetrise(kept))
    if binary:
        out = out.withColumn("w", F.lit(1.0))
    if self_loops == "unit":
        ids = nodes.select("node_id").distinct() if nodes is not None else edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
        out = out.unionByName(ids.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("w")))
    return out


def weighted_adjacency(edges: DataFrame, embeddings: DataFrame, clamp: bool = False) -> DataFrame:
    """M7: symmetric adjacency of cosine weights; ``clamp`` raises negative ones to 0."""
    out = coalesce_edges(symmetrise(edge_weights(edges, embeddings), "weight"))
    return out.withColumn("w", F.greatest("w", F.lit(0.0))) if clamp else out


def asymmetry(matrix: DataFrame) -> DataFrame:
    """The largest |w(i, j) - w(j, i)|; at most 1e-10 in a symmetric matrix. Summed by unordered pair, without a join."""
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    signed = matrix.where("i <> j").select(lo.alias("a"), hi.alias("b"), F.when(F.col("i") < F.col("j"), F.col("w")).otherwise(-F.col("w")).alias("w"))
    return signed.groupBy("a", "b").agg(F.abs(F.sum("w")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_difference"))


def degrees(matrix: DataFrame) -> DataFrame:
    """(i, degree): row sums; a zero sum counts as 1."""
    return matrix.groupBy("i").agg(F.sum("w").alias("d")).select("i", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("degree"))


def normalized_laplacian(matrix: DataFrame, random_walk: bool = False) -> DataFrame:
    """I - D^-1/2 A D^-1/2, or I - D^-1 A, as (i, j, w); every node has its diagonal."""
    d = degrees(matrix)
    row = matrix.join(d, "i")
    if random_walk:
        scaled = row.select("i", "j", (-F.col("w") / F.col("degree")).alias("w"))
    else:
        scaled = row.join(d.toDF("j", "dj"), "j").select("i", "j", (-F.col("w") / F.sqrt(F.abs(F.col("degree") * F.col("dj")))).alias("w"))
    return coalesce_edges(scaled.unionByName(d.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, distinct edges, directed density, mean degree of the undirected graph."""
    m = edges.distinct().agg(F.count("*").alias("n_edges"))
    return nodes.agg(F.countDistinct("node_id").alias("n_nodes")).crossJoin(F.broadcast(m)).select("n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"), F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("average_degree"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable, edges taken in both directions; isolated nodes are their own."""
    found = connected_components(edges, "source", "target").withColumnRenamed("node", "node_id")
    return nodes.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_summary(comp: DataFrame) -> DataFrame:
    """Whether weakly connected, number of components, size of the largest."""
    return comp.groupBy("component").agg(F.count("*").alias("n")).agg((F.count("*") <= 1).alias("connected"), F.count("*").alias("n_components"), F.max("n").alias("largest"))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct (node, neighbour) pairs, out, in or both ways."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def neighbour_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbers of distinct out-, in- and all neighbours of each node."""
    each = [neighbours(edges, d).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias(f"n_{d}")) for d in ("out", "in", "both")]
    out = nodes.select("node_id").distinct()
    for e in each:
        out = out.join(e, "node_id", "left")
    return out.fillna(0)


def citation_similarity(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, sim) > 0 of nodes of ``left`` and ``right``: cosine of their binary neighbour vectors.

    Nodes meet on a shared neighbour; the pairs' counts are summed before the
    shuffle where they can be. A hub's rows are split by adaptive execution.
    """
    links = neighbours(edges)
    degree = links.groupBy("node").agg(F.count("*").alias("deg"))
    part = lambda ids, name: links.join(ids.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", name)
    shared = part(left, "i").join(part(right, "j"), "neighbour").groupBy("i", "j").agg(F.count("*").alias("n"))
    return shared.join(degree.toDF("i", "di"), "i").join(degree.toDF("j", "dj"), "j").select("i", "j", (F.col("n") / F.sqrt(F.col("di") * F.col("dj"))).alias("sim"))

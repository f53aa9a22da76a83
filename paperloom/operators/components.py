"""Connected components by alternating large-star and small-star rounds.

Each round shuffles edges by node and keeps one minimum per node, so no
neighbour list is ever gathered; a hub's edges are joined with its single
minimum, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import scratch


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # dealt out anew: a join whose both sides are shuffled for it can be split where a hub's edges meet
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u", "m")
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u", "m")
    linked = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return linked.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "source", dst: str = "target", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest node.

    Rows with a null end and self-loops only name a node (a self-loop node is
    its own component). The rounds needed grow with the logarithm of the size.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs, start = scratch.stage(pairs.distinct(), "edges")
    now, path, seen = pairs.where("u <> v"), None, None
    for _ in range(max_rounds):
        now, new = scratch.stage(_stars(now), "stars")
        if path:
            scratch.drop(edges.sparkSession, path)
        path = new
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    return nodes.join(now.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").withColumn("component", F.coalesce("component", "node"))

"""External and internal measures of a clustering, as aggregates over the contingency table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.operators.sampling import rank_by_hash
from paperloom.operators.similarity import _matrix, block_pairs

#: Rows and columns of distances that are held at once: as much as a processor's cache has.
TILE = (256, 1024)


def contingency(labels: DataFrame, truth: str = "class_idx", found: str = "cluster_id") -> DataFrame:
    """(a, b, n): members of class a in cluster b. Everything below reads this small table."""
    return labels.groupBy(F.col(truth).alias("a"), F.col(found).alias("b")).agg(F.count("*").alias("n"))


def _pairs(n):
    return n.cast("double") * (n - 1) / 2


def adjusted_rand(labels: DataFrame, truth: str = "class_idx", found: str = "cluster_id") -> DataFrame:
    """Adjusted Rand index; 1 where it is not defined."""
    t = contingency(labels, truth, found)
    total = t.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("N"))
    side = lambda c, name: t.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias(name))
    one = total.crossJoin(F.broadcast(side("a", "sa"))).crossJoin(F.broadcast(side("b", "sb")))
    expected, mean = F.col("sa") * F.col("sb") / _pairs(F.col("N")), (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when((F.col("N") < 2) | (mean == expected), 1.0).otherwise((F.col("s") - expected) / (mean - expected)).alias("ari"))


def _information(labels: DataFrame, truth: str, found: str) -> DataFrame:
    t = contingency(labels, truth, found)
    total = F.broadcast(t.agg(F.sum("n").alias("all")))
    entropy = lambda c, name: t.groupBy(c).agg(F.sum("n").alias("m")).crossJoin(total).agg(F.sum(-F.col("m") / F.col("all") * F.log(F.col("m") / F.col("all"))).alias(name))
    ra, rb = (t.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    mi = t.join(ra, "a").join(rb, "b").crossJoin(total).agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n").cast("double") * F.col("all") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"))
    return mi.crossJoin(F.broadcast(entropy("a", "ha"))).crossJoin(F.broadcast(entropy("b", "hb")))


def information_scores(labels: DataFrame, truth: str = "class_idx", found: str = "cluster_id") -> DataFrame:
    """Nmi (arithmetic mean), homogeneity, completeness, v_measure; natural logarithms; 1 where an entropy is zero."""
    x = _information(labels, truth, found)
    h = F.when(F.col("ha") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("ha"))
    c = F.when(F.col("hb") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("hb"))
    both = F.col("ha") + F.col("hb")
    return x.select(F.when(both <= 1e-15, 1.0).otherwise(2 * F.col("mi") / both).alias("nmi"), h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"))


def silhouette_values(df: DataFrame, block: int | None = None) -> DataFrame:
    """(node_id, cluster_id, silhouette), Euclidean, of (node_id, cluster_id, embedding); 0 in a cluster of one, no rows for a single cluster.

    Blocks of vectors give sums of distances by point and cluster; means follow
    by aggregation.
    """

    def kernel(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:  # noqa: E741
        order = np.argsort(r.column("cluster_id").to_numpy(), kind="stable")
        groups, starts = np.unique(r.column("cluster_id").to_numpy()[order], return_index=True)
        x, y = _matrix(l.column("embedding")), _matrix(r.column("embedding"))[order]
        ids, ry = l.column("node_id").to_numpy(), r.column("node_id").to_numpy()[order]
        place, same = np.repeat(np.arange(len(groups)), np.diff([*starts, len(y)])), np.isin(ids, ry).any()
        # the square of a distance as one product: -2 x y + y y + x x
        left = np.concatenate([-2 * x, np.ones((len(x), 1)), (x**2).sum(1)[:, None]], axis=1)
        right = np.concatenate([y, (y**2).sum(1)[:, None], np.ones((len(y), 1))], axis=1)
        for at in range(0, len(x), TILE[0]):
            sums = np.zeros((len(left[at : at + TILE[0]]), len(groups)))
            for of in range(0, len(y), TILE[1]):
                d = left[at : at + TILE[0]] @ right[of : of + TILE[1]].T
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if same:
                    d[ids[at : at + TILE[0], None] == ry[None, of : of + TILE[1]]] = 0
                here, first = np.unique(place[of : of + TILE[1]], return_index=True)
                sums[:, here] += np.add.reduceat(d, first, axis=1)
            yield pa.table({"node_id": np.repeat(ids[at : at + TILE[0]], len(groups)), "other": np.tile(groups, len(sums)).astype(np.int64), "total": sums.ravel()})

    # read five times below: what assigns the clusters runs once
    v = scratch.staged(df.select(F.col("node_id").cast("long").alias("node_id"), F.col("cluster_id").cast("long").alias("cluster_id"), "embedding"), "clustered")
    sums = block_pairs(v, v, kernel, "node_id bigint, other bigint, total double", block).groupBy("node_id", "other").agg(F.sum("total").alias("total"))
    sizes = v.groupBy(F.col("cluster_id").alias("other")).agg(F.count("*").alias("size"))
    own = F.col("cluster_id") == F.col("other")
    each = v.select("node_id", "cluster_id").join(sums, "node_id").join(sizes, "other")
    ab = each.groupBy("node_id", "cluster_id").agg(F.max(F.when(own, F.col("size"))).alias("size"), F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    return ab.where("b is not null").select("node_id", "cluster_id", F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def silhouette(df: DataFrame, block: int | None = None) -> DataFrame:
    """The mean silhouette; null for a single cluster (Q24)."""
    return silhouette_values(df, block).agg(F.avg("silhouette").alias("silhouette"))


def proportional_sample(df: DataFrame, size: int = 2000, seed: int = 42) -> DataFrame:
    """max(1, floor(n_c * size / n)) rows of each cluster, by the order of md5(id, seed)."""
    n = df.count()
    if n <= size:
        return df
    sizes = df.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    ranked = rank_by_hash(df, "cluster_id", seed).join(sizes, "cluster_id")
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * size / n))).select(*df.columns)


def silhouette_sampled(df: DataFrame, size: int = 2000, seed: int = 42, above: int = 10_000) -> DataFrame:
    """The mean silhouette of a proportional sample if there are more than ``above`` rows, else of all."""
    return silhouette(proportional_sample(df, size, seed) if df.count() > above else df)

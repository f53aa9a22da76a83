"""Eigenvectors, k-means, and eigen-gaps.

Up to ``DENSE`` nodes the Laplacian's smallest eigenpairs are computed exactly
in one task-sized matrix on the driver (its size is checked first). Beyond,
subspace iteration with Chebyshev filters runs as sparse products of strips of the matrix
with a block of vectors (``strips``), none of which is shuffled, until the residuals are small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.functions.vector import unit
from paperloom.operators.graph import normalized_laplacian
from paperloom.operators.strips import Strips, chebyshev_zeros

DENSE = 3000
#: Of the iteration: vectors beside those asked for, products of a filter at most, and the logarithm of its growth at most.
GUARD, DEGREE, GROWTH = 16, 20, 23.0


def _clean(values: np.ndarray) -> np.ndarray:
    """tiny values to 0, none negative."""
    v = np.where(np.abs(values) < 1e-10, 0.0, values)
    return np.maximum(v, 0.0)


def _dense(lap: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = lap.toArrow()
    ids = np.unique(table.column("i").to_numpy())
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (np.searchsorted(ids, table.column("i").to_numpy()), np.searchsorted(ids, table.column("j").to_numpy())), table.column("w").to_numpy())
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return ids, _clean(values), vectors


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gram(x: DataFrame, columns: list[str]) -> np.ndarray:
    """The Gram matrix of the array columns side by side, summed by partition."""

    def run(batches):
        total = None
        for t in batches:
            if t.num_rows:
                m = np.concatenate([_matrix(t.column(c)) for c in columns], axis=1)
                total = m.T @ m + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "x": total.ravel()})

    sums = x.select(*columns).mapInArrow(run, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(sums.num_rows)
    out[sums.column("cell").to_numpy()] = sums.column("x").to_numpy()
    return out.reshape(math.isqrt(len(out)), -1)


def _times(x: DataFrame, made: dict[str, list[tuple[str, np.ndarray]]]) -> DataFrame:
    """(i, ...): each named column is the sum of the given columns times their matrices."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                out = [sum(_matrix(t.column(c)) @ m for c, m in parts) for parts in made.values()]
                yield pa.RecordBatch.from_arrays([t.column("i"), *[pa.array(list(v), pa.list_(pa.float64())) for v in out]], names=["i", *made])

    return x.mapInArrow(run, ", ".join(["i bigint", *[f"{n} array<double>" for n in made]]))


def _product(matrix: DataFrame, x: DataFrame, column: str, p: int, name: str) -> DataFrame:
    """(i, ``name``): the sparse matrix (i, j, w) times the block of vectors in a column of p values."""
    part = matrix.join(x.select(F.col("i").alias("j"), F.col(column).alias("x")), "j").select("i", *[(F.col("w") * F.get("x", F.lit(c))).alias(f"c{c}") for c in range(p)])
    return part.groupBy("i").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(p)]).select("i", F.array(*[f"c{c}" for c in range(p)]).alias(name))


def _iterate(lap: DataFrame, k: int, steps: int, seed: int, tol: float) -> tuple[np.ndarray, DataFrame]:
    """Subspace iteration with Chebyshev filters: (eigenvalues, (node_id, v)).

    A round is a filter of up to ``DEGREE`` products and a Rayleigh-Ritz step;
    it ends when ||L v - value v|| of all k pairs is at most ``tol``, and raises
    after ``steps`` rounds. Only matrices of the block's width reach the driver.
    """
    strips = Strips(lap, k + GUARD)
    p = min(strips.n, k + GUARD)
    # a Laplacian of weights that aren't negative ends at 2, any matrix at its largest absolute row sum
    odd = lap.agg(F.max(F.col("i") != F.col("j")).alias("edges"), F.max(F.when(F.col("i") != F.col("j"), F.col("w"))).alias("w")).first()
    top = 2.0 if not odd.edges or odd.w <= 0 else lap.groupBy("i").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0]
    try:
        v, worst = strips.start(p, seed), np.inf
        for _ in range(steps):
            m = strips.orthogonal(v, p)
            both, g = strips.ritz(v, m)
            p = m.shape[1]
            ritz, turn = np.linalg.eigh((g[:p, p:] + g[p:, :p]) / 2)
            worst = np.sqrt(np.maximum(0, np.diag(turn.T @ g[p:, p:] @ turn) - ritz**2))[:k].max()
            if worst <= tol:
                return _clean(ritz[:k]), strips.rows(both, turn[:, :k])
            # the filter is small from the block's largest value to the spectrum's end, and grows below; by a bounded factor, to keep digits
            centre, half = (top + ritz[-1]) / 2, max((top - ritz[-1]) / 2, 1e-3)
            degree = max(2, min(DEGREE, int(GROWTH / max(1e-9, math.acosh(max(1.0, (centre - ritz[0]) / half))))))
            v = strips.filtered(both, turn, chebyshev_zeros(degree, centre, half), half / 2)
    finally:
        strips.close()
    raise RuntimeError(f"eigenvectors did not converge: residual {worst:.1e} after {steps} rounds, asked {tol:.1e}")


def eigenpairs(matrix: DataFrame, k: int, dense: int = DENSE, steps: int = 200, tol: float = 1e-6, seed: int = 42) -> tuple[list[float], DataFrame]:
    """The k smallest eigenvalues of the matrix's normalised Laplacian, and (node_id, v) with the eigenvectors' rows."""
    lap = scratch.staged(normalized_laplacian(matrix), "laplacian")
    n = lap.select("i").distinct().count()
    k = min(k, n)
    if n <= dense:
        ids, values, vectors = _dense(lap)
        rows = pa.table({"node_id": pa.array(ids, pa.int64()), "v": pa.array(list(vectors[:, :k]), pa.list_(pa.float64()))})
        return values[:k].tolist(), lap.sparkSession.createDataFrame(rows)
    values, rows = _iterate(lap, k, steps, seed, tol)
    return values.tolist(), rows


def _lloyd(x: np.ndarray, k: int, n_init: int, max_iter: int, seed: int) -> np.ndarray:
    """k-means++ starts and Lloyd's steps; the labels of the cheapest of ``n_init`` runs."""
    best, cost = np.zeros(len(x), int), np.inf
    sq = (x**2).sum(1)
    for run in range(n_init):
        rng = np.random.default_rng(seed + run)
        centres = x[[rng.integers(len(x))]]
        near = ((x - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            total = near.sum()
            pick = rng.integers(len(x)) if total <= 0 else int(np.searchsorted(np.cumsum(near), rng.random() * total))
            centres = np.vstack([centres, x[min(pick, len(x) - 1)]])
            near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
        labels = None
        for _ in range(max_iter):
            d = sq[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T
            new = d.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            sums, counts = np.zeros_like(centres), np.bincount(labels, minlength=k)
            np.add.at(sums, labels, x)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        now = np.maximum(d[np.arange(len(x)), new], 0).sum()
        if now < cost:
            best, cost = new, now
    return best


def kmeans(rows: DataFrame, k: int, vector: str = "features", n_init: int = 10, max_iter: int = 300, seed: int = 42, dense: int = DENSE) -> DataFrame:
    """(node_id, cluster_id): the best of ``n_init`` k-means runs by cost. Up to ``dense`` rows (counted first) run in memory, more as distributed k-means."""
    points = rows.select(F.col("node_id").cast("long").alias("node_id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    points = scratch.staged(points, "points")
    n = points.count()
    if n <= dense:
        t = points.toArrow()
        order = np.argsort(t.column("node_id").to_numpy())
        ids, x = t.column("node_id").to_numpy()[order], np.array(t.column("x").to_pylist(), dtype=float)[order]
        labels = _lloyd(x, min(k, n), n_init, max_iter, seed) if n else np.zeros(0, int)
        return rows.sparkSession.createDataFrame(pa.table({"node_id": pa.array(ids, pa.int64()), "cluster_id": pa.array(labels.astype(np.int32))}))
    data = points.select("node_id", array_to_vector("x").alias("x")).cache()
    best = None
    for i in range(n_init):
        m = KMeans(k=k, featuresCol="x", maxIter=max_iter, seed=seed + i, predictionCol="cluster_id").fit(data)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    data.unpersist()
    return best.transform(points.select("node_id", array_to_vector("x").alias("x"))).select("node_id", "cluster_id")


def spectral_features(matrix: DataFrame, dims: int = 50, normalise: bool = False) -> DataFrame:
    """(node_id, features): eigenvectors 2 .. dims + 1."""
    _, rows = eigenpairs(matrix, dims + 1)
    out = rows.select("node_id", F.slice("v", 2, dims).alias("features"))
    return out.withColumn("features", unit("features")) if normalise else out


def spectral_cluster(matrix: DataFrame, k: int, row_normalise: bool = False, n_init: int = 10, seed: int = 42) -> DataFrame:
    """M11 (eigenvector rows scaled by D^-1/2), M12 (``row_normalise``): (node_id, cluster_id) from an affinity matrix (i, j, w)."""
    from paperloom.operators.graph import degrees

    _, rows = eigenpairs(matrix, k)
    if row_normalise:
        features = rows.select("node_id", unit("v").alias("features"))
    else:
        d = degrees(matrix).select(F.col("i").alias("node_id"), "degree")
        features = rows.join(d, "node_id").select("node_id", F.transform("v", lambda x: x / F.sqrt(F.abs("degree"))).alias("features"))
    return kmeans(features, k, n_init=n_init, seed=seed)


def _within(m: DataFrame, ids: DataFrame) -> DataFrame:
    """The matrix between the given nodes, made symmetric; every node has a row."""
    part = m.join(ids.toDF("i"), "i", "left_semi").join(ids.toDF("j"), "j", "left_semi").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("w") / 2).alias("w"))
    loops = ids.select(F.col("node_id").cast("long").alias("i"), F.col("node_id").cast("long").alias("j"), F.lit(0.0).alias("w"))
    return part.unionByName(part.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).unionByName(loops).groupBy("i", "j").agg(F.sum("w").alias("w"))


def _absolute_sums(u: DataFrame) -> DataFrame:
    """(i, d): the absolute row sums of (U Z' + Z U') / 2 for the rows (i, u, z), by blocks; 0 counts as 1."""
    from paperloom.operators.similarity import block_pairs, pieces

    def kernel(l: pa.Table, r: pa.Table):  # noqa: E741
        mine, other = (np.concatenate([_matrix(t.column(c).combine_chunks()) for c in names], axis=1) for t, names in ((l, ("u", "z")), (r, ("z", "u"))))
        total = np.zeros(len(mine))
        for at in pieces(len(mine), len(other)):
            part = mine[at] @ other.T
            total[at] = np.abs(part, out=part).sum(1) / 2
        yield pa.table({"i": l.column("i"), "d": total})

    sums = block_pairs(u, u, kernel, "i bigint, d double", id_col="i").groupBy("i").agg(F.sum("d").alias("d"))
    return sums.select("i", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("d"))


def _cotrained(views: list[DataFrame], k: int, rounds: int) -> DataFrame:
    """(node_id, features) of co-training on two symmetric matrices (i, j, w) over the same nodes.

    A turned view S = (U Z' + Z U') / 2 with Z = K U, for the other view's
    vectors U, is never built: its row sums are added up by blocks, and its
    leading vectors follow from the 2k x 2k Gram matrix of U and Z.
    """

    def scaled(m: DataFrame) -> DataFrame:
        d = m.groupBy("i").agg(F.sum(F.abs("w")).alias("d")).select("i", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("d"))
        lap = m.join(d, "i").join(d.toDF("j", "dj"), "j").select("i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("w") / F.sqrt(F.col("d") * F.col("dj"))).alias("w"))
        return scratch.staged(lap, "laplacian")

    def turned(k_own: DataFrame, other: DataFrame) -> DataFrame:
        z = _product(k_own, other, "v", k, "z")
        uz = scratch.staged(other.withColumnRenamed("v", "u").join(z, "i").select("i", "u", "z"), "turned")
        by = lambda c: F.transform(c, lambda x: x / F.sqrt("d")).alias(c)
        b = scratch.staged(uz.join(_absolute_sums(uz), "i").select("i", by("u"), by("z")), "turned")
        g = _gram(b, ["u", "z"])
        scale = np.sqrt(np.diag(g))
        scale[scale == 0] = 1
        size, base = np.linalg.eigh(g / scale[:, None] / scale[None, :])
        some = size > 1e-12 * size[-1]
        q = base[:, some] / np.sqrt(size[some]) / scale[:, None]  # B q is orthonormal
        half = np.zeros((2 * k, 2 * k))
        half[:k, k:] = half[k:, :k] = np.eye(k) / 2
        _, turn = np.linalg.eigh(q.T @ g @ half @ g @ q)
        top = q @ turn[:, -k:]
        top = np.concatenate([np.zeros((2 * k, k - top.shape[1])), top], axis=1)
        return scratch.staged(_times(b, {"v": [("u", top[:k]), ("z", top[k:])]}), "turned")

    tops = [scratch.staged(_iterate(scaled(m), k, 200, 42, 1e-6)[1].withColumnRenamed("node_id", "i"), "tops") for m in views]
    for _ in range(rounds):
        tops = [turned(views[i], tops[1 - i]) for i in (0, 1)]
    both = tops[0].join(tops[1].select("i", F.col("v").alias("w")), "i")
    return both.select(F.col("i").alias("node_id"), unit(F.concat("v", "w")).alias("features"))


def multiview_cluster(first: DataFrame, second: DataFrame, k: int, rounds: int = 3, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Co-trained spectral clustering of two affinity matrices over the same nodes.

    In each round a view's affinity is projected on the other view's leading
    eigenvectors and made symmetric; then the concatenated, row-normalised eigenvectors
    are clustered. Beyond ``DENSE`` nodes the same is computed on the edge lists.
    """
    ids = first.select(F.col("i").alias("node_id")).distinct().join(second.select(F.col("i").alias("node_id")).distinct(), "node_id", "left_semi")
    if ids.count() > DENSE:
        x = _cotrained([scratch.staged(_within(m, ids), "view") for m in (first, second)], k, rounds)
        return kmeans(x, k, n_init=n_init, seed=seed)
    order = np.sort(ids.toArrow().column("node_id").to_numpy())

    def full(m: DataFrame) -> np.ndarray:
        t = m.join(ids.toDF("i"), "i", "left_semi").join(ids.toDF("j"), "j", "left_semi").toArrow()
        out = np.zeros((len(order), len(order)))
        np.add.at(out, (np.searchsorted(order, t.column("i").to_numpy()), np.searchsorted(order, t.column("j").to_numpy())), t.column("w").to_numpy())
        return (out + out.T) / 2

    def leading(s: np.ndarray) -> np.ndarray:
        d = np.abs(s).sum(1)
        d[d == 0] = 1
        return np.linalg.eigh(s / np.sqrt(d)[:, None] / np.sqrt(d)[None, :])[1][:, -k:]

    views = [full(first), full(second)]
    tops = [leading(s) for s in views]
    for _ in range(rounds):
        turned = [tops[1 - i] @ (tops[1 - i].T @ views[i]) for i in (0, 1)]
        tops = [leading((t + t.T) / 2) for t in turned]
    x = np.concatenate(tops, axis=1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    rows = first.sparkSession.createDataFrame(pa.table({"node_id": pa.array(order, pa.int64()), "features": pa.array(list(x), pa.list_(pa.float64()))}))
    return kmeans(rows, k, n_init=n_init, seed=seed)


def eigen_gaps(values: DataFrame, max_k: int | None = None) -> DataFrame:
    """(k, eigenvalue, eigen_gap, relative_gap, gap_ratio) of (idx, eigenvalue), idx from 0; the relative gap's denominator is guarded (Q23).

    The eigenvalues are a few dozen rows, so one task orders them.
    """
    w = Window.orderBy("idx")
    nxt = F.lead("eigenvalue").over(w)
    gaps = values.select((F.col("idx") + 1).cast("int").alias("k"), "eigenvalue", (nxt - F.col("eigenvalue")).alias("eigen_gap"), ((nxt - F.col("eigenvalue")) / (nxt + 1e-10)).alias("relative_gap"), "idx").where("eigen_gap is not null")
    gaps = gaps.where(F.col("k") <= max_k) if max_k else gaps
    last = F.lag("relative_gap").over(w)
    return gaps.select("k", "eigenvalue", "eigen_gap", "relative_gap", F.when(last != 0, F.col("relative_gap") / last).alias("gap_ratio"))


def eigen_gap_table(gaps: DataFrame) -> DataFrame:
    """Rank and percentile of each gap, and the first three choices of k by relative gap."""
    best = F.row_number().over(Window.orderBy(F.desc("relative_gap"), "k"))
    rank = F.row_number().over(Window.orderBy(F.desc("eigen_gap"), "k"))
    share = 100 * F.cume_dist().over(Window.orderBy("eigen_gap"))
    return gaps.select("k", "eigenvalue", "eigen_gap", rank.alias("gap_rank"), share.alias("gap_percentile"), *[(best == i).alias(n) for i, n in ((1, "is_optimal"), (2, "is_second_choice"), (3, "is_third_choice"))])


def gap_statistics(values: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: the optimal k and how far its gap stands out."""
    stats = gaps.agg(F.max_by("k", F.struct("relative_gap", -F.col("k"))).alias("optimal_k"), F.max_by("k", F.struct("eigen_gap", -F.col("k"))).alias("optimal_k_absolute"), F.max_by("eigen_gap", F.struct("relative_gap", -F.col("k"))).alias("largest_gap"), F.max("relative_gap").alias("largest_relative_gap"), F.avg("eigen_gap").alias("mean_gap"), F.stddev_pop("eigen_gap").alias("std_gap"), F.stddev_pop("relative_gap").alias("_rs"))
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("eigenvalue")))
    base = values.agg(F.count_if(F.col("eigenvalue") < 1e-8).alias("n_zero"), (at(1) - at(0)).alias("spectral_gap"), F.when(at(1) != 0, at(10) / at(1)).alias("eigenvalue_decay"))
    return stats.crossJoin(F.broadcast(base)).withColumns({"gap_significance": F.col("largest_gap") / F.nullif(F.col("std_gap"), F.lit(0.0)), "relative_gap_significance": F.col("largest_relative_gap") / F.nullif(F.col("_rs"), F.lit(0.0)), "largest_gap_ratio": F.col("largest_gap") / F.nullif(F.col("mean_gap"), F.lit(0.0))}).drop("_rs")


def eigenvalue_frame(spark, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx int, eigenvalue double")

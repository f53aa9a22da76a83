"""Exact similarity joins.

All-pairs work runs in blocks: ids are dealt into blocks of some ten thousand
vectors, each packed into one cell. Each pair of blocks is one task of a matrix
product, which reads both where they lie: a vector is shuffled once, not once for
each block it meets. Only top-k rows, pairs above a threshold or sums leave a task, a
piece at a time; nothing is broadcast that grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.functions.vector import cosine, rescale

#: Numbers of a block and of a piece of a product, at most.
BLOCK, PIECE = 1 << 22, 1 << 21


def _blocks(n: int, width: int, block: int | None) -> int:
    return max(1, math.ceil(n / (block or max(1, BLOCK // max(1, width)))), min(4, math.ceil(n / 256)), min(8, math.ceil(n / 4096)))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten()
    if len(values) and not values.null_count and not flat.null_count and len(np.unique(np.diff(values.offsets.to_numpy()))) == 1:
        return flat.to_numpy().astype(float).reshape(len(values), -1)
    return np.array(values.to_pylist(), dtype=float)


def pieces(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows of a product with so many columns."""
    step = max(1, min(512, PIECE // max(1, columns)))
    return (slice(at, at + step) for at in range(0, rows, step))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


Kernel = Callable[[pa.Table, pa.Table], Iterator[pa.Table]]


def _packed(df: DataFrame, block: int | None, id_col: str) -> tuple[DataFrame, int]:
    """(block, rows): each block's rows as an Arrow stream; the number of blocks."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    size = df.agg(F.count("*").alias("n"), *[F.max(F.size(c)).alias(c) for c in lists]).first()
    n = _blocks(size["n"], sum(size[c] or 0 for c in lists), block)

    def pack(key, t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t.combine_chunks())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    place = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block")
    cells = df.withColumn("_block", place).groupBy("_block").applyInArrow(lambda key, t: pack(key, t.drop_columns(["_block"])), "block int, rows binary")
    return scratch.stage(cells, "blocks", packed=True)[0], n


def block_pairs(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, block: int | None = None, id_col: str = "node_id") -> DataFrame:
    """U4: ``kernel`` on every pair of a block of the left and one of the right rows, each pair once, in a task of its own."""
    (x, a), (y, b) = _packed(left, block, id_col), _packed(right, block, id_col) if right is not left else (None, 0)
    y, b = (x, a) if y is None else (y, b)

    def run(batches):
        for t in batches:
            for mine, other in zip(t.column("l"), t.column("r")):
                for out in kernel(*(pa.ipc.open_stream(cell.as_buffer()).read_all() for cell in (mine, other))):
                    yield from out.to_batches(max_chunksize=1 << 16)

    # a block a partition on both sides, so a pair of blocks a task
    lhs = x.repartitionById(a, F.col("block")).select(F.col("rows").alias("l"))
    rhs = y.repartitionById(b, F.col("block")).select(F.col("rows").alias("r"))
    return lhs.crossJoin(rhs.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def _topk(k: int, skip_self: bool) -> Kernel:
    def kernel(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:  # noqa: E741
        li, ri = l.column("node_id").to_numpy(), r.column("node_id").to_numpy()
        order = np.argsort(ri)
        ri = ri[order]
        x, y = _unit(_matrix(l.column("embedding"))), _unit(_matrix(r.column("embedding")))[order]
        same = skip_self and np.isin(li, ri).any()
        group = max(1, min(64, len(ri) // (8 * k)))
        whole = len(ri) // group * group
        for at in pieces(len(li), len(ri)):
            sims = x[at] @ y.T
            if same:
                sims[li[at, None] == ri[None, :]] = -np.inf
            # the k-th largest of the groups' maxima is no more than the k-th largest value
            tops = sims[:, :whole].reshape(len(sims), -1, group).max(2) if group > 1 else sims
            keep = min(k, tops.shape[1])
            edge = np.partition(tops, tops.shape[1] - keep, axis=1)[:, tops.shape[1] - keep, None]
            a, b = np.nonzero((sims >= edge - 1e-12) & np.isfinite(sims))
            # summed alike for every pair: equal vectors are equally similar, whatever their place in a product
            s = np.concatenate([np.zeros(0), *((x[at][a[of : of + 65536]] * y[b[of : of + 65536]]).sum(1) for of in range(0, len(a), 65536))])
            best = np.lexsort((b, -s, a))
            a, b, s = a[best], b[best], s[best]
            first = np.arange(len(a)) - np.searchsorted(a, a) < k
            yield pa.table({"i": li[at][a[first]], "j": ri[b[first]], "sim": s[first]})

    return kernel


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(df: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(i, j, sim, rank): the k most similar others by cosine, never itself (Q22); of equals the smaller id."""
    v = df.select(F.col("node_id").cast("long").alias("node_id"), "embedding")
    return _best(block_pairs(v, v, _topk(k, True), "i bigint, j bigint, sim double", block), k)


def knn_between(queries: DataFrame, base: DataFrame, k: int = 3, block: int | None = None) -> DataFrame:
    """The k most similar base vectors of each query."""
    pick = lambda d: d.select(F.col("node_id").cast("long").alias("node_id"), "embedding")
    return _best(block_pairs(pick(queries), pick(base), _topk(k, False), "i bigint, j bigint, sim double", block), k)


def pairs_above(df: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(i, j, sim) of all ordered pairs with at least this cosine, each vector with itself too."""

    def kernel(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:  # noqa: E741
        li, ri = l.column("node_id").to_numpy(), r.column("node_id").to_numpy()
        x, y = _unit(_matrix(l.column("embedding"))), _unit(_matrix(r.column("embedding")))
        for at in pieces(len(li), len(ri)):
            sims = x[at] @ y.T
            a, b = np.nonzero(sims >= least)
            yield pa.table({"i": li[at][a], "j": ri[b], "sim": sims[a, b]})

    v = df.select(F.col("node_id").cast("long").alias("node_id"), "embedding")
    return block_pairs(v, v, kernel, "i bigint, j bigint, sim double", block)


def similarity_stats(df: DataFrame, block: int | None = None) -> DataFrame:
    """Mean, population deviation, least and largest cosine over all ordered pairs, each vector with itself too. One row leaves each pair of blocks."""

    def kernel(l: pa.Table, r: pa.Table) -> Iterator[pa.Table]:  # noqa: E741
        n = s = q = 0.0
        lo, hi = math.inf, -math.inf
        x, y = _unit(_matrix(l.column("embedding"))), _unit(_matrix(r.column("embedding")))
        for at in pieces(len(x), len(y)):
            sims = x[at] @ y.T
            n, s, lo, hi = n + sims.size, s + sims.sum(), min(lo, sims.min()), max(hi, sims.max())
            q += np.square(sims, out=sims).sum()
        yield pa.table({"n": [n], "s": [s], "q": [q], "lo": [lo], "hi": [hi]})

    v = df.select(F.col("node_id").cast("long").alias("node_id"), "embedding")
    parts = block_pairs(v, v, kernel, "n double, s double, q double, lo double, hi double", block)
    mean = F.sum("s") / F.sum("n")
    return parts.where("n > 0").agg(mean.alias("mean_sim"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("std_sim"), F.min("lo").alias("min_sim"), F.max("hi").alias("max_sim"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "w").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def knn_graph_assigned(df: DataFrame, k: int = 10) -> DataFrame:
    """M1: weights max(0, sim), symmetric; a mutual pair keeps one weight (Q2); zero weights stay out."""
    pairs = knn(df, k).select("i", "j", F.greatest("sim", F.lit(0.0)).alias("w"))
    return _both_ways(pairs).groupBy("i", "j").agg(F.max("w").alias("w")).where("w > 0")


def knn_graph_summed(df: DataFrame, k: int = 20) -> DataFrame:
    """Positive similarities, both directions added, so a mutual pair counts twice (Q2); diagonal 1."""
    pairs = knn(df, k).where("sim > 0").select("i", "j", F.col("sim").alias("w"))
    own = df.select(F.col("node_id").cast("long").alias("i"), F.col("node_id").cast("long").alias("j"), F.lit(1.0).alias("w"))
    return _both_ways(pairs).groupBy("i", "j").agg(F.sum("w").alias("w")).unionByName(own)


def epsilon_graph(df: DataFrame, epsilon: float = 0.7) -> DataFrame:
    """M3: all pairs with at least this similarity; the diagonal is among them."""
    return pairs_above(df, epsilon).select("i", "j", F.col("sim").alias("w"))


def full_graph(df: DataFrame, least: float | None = None) -> DataFrame:
    """M4 (no ``least``), M5 (0.01): similarities, those below ``least`` left out, rescaled to [0, 1]."""
    return pairs_above(df, -math.inf if least is None else least).select("i", "j", rescale("sim").alias("w"))


def edge_weights(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The cosine of both ends of each edge that has vectors for both; negative ones stay (Q5)."""
    a, b = (embeddings.select(F.col("node_id").alias(k), F.col("embedding").alias(f"_{k}")) for k in ("source", "target"))
    return edges.join(a, "source").join(b, "target").select("source", "target", cosine("_source", "_target").alias("weight"))


def edges_without_vectors(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """the edges that lack a vector at either end."""
    ids = embeddings.select("node_id")
    has = lambda e, k: e.join(ids, F.col(k) == F.col("node_id"), "left_anti")
    return has(edges, "source").unionByName(has(edges.join(ids, F.col("source") == F.col("node_id"), "left_semi"), "target"))


def weight_stats(weighted: DataFrame) -> DataFrame:
    """Number, mean, sample deviation, least and largest edge weight."""
    return weighted.agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"), F.stddev_samp("weight").alias("std_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


def centroids(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster_id, centroid): mean vector of each cluster, by partial sums of its components."""
    parts = df.select("cluster_id", F.posexplode(vector).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def _nearest(df: DataFrame, cents: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """Rows with the best centroid, found within the row over the array of all centroids: no join of rows, no shuffle."""
    n = cents.count()
    if n > 10_000:
        raise ValueError(f"{n} centroids; use knn_between")
    table = cents.agg(F.sort_array(F.collect_list(F.struct("cluster_id", *[c for c in cents.columns if c != "cluster_id"]))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(score(c).alias("score"), (-c["cluster_id"]).alias("neg")))
    return df.crossJoin(F.broadcast(table)).withColumn("_b", F.array_max(scored)).withColumns({"cluster_id": -F.col("_b.neg"), "score": F.col("_b.score")}).drop("_c", "_b")


def nearest_centroid(df: DataFrame, cents: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with the cluster_id of the most similar centroid and its cosine ``score``; of equals the smallest id."""
    return _nearest(df, cents.select("cluster_id", "centroid"), lambda c: cosine(vector, c["centroid"]))


def blended_centroid(df: DataFrame, text: DataFrame, spectral: DataFrame, alpha: float = 0.5, text_vector: str = "embedding", spectral_vector: str = "features") -> DataFrame:
    """The cluster with the largest alpha * cosine(text) + (1 - alpha) * cosine(spectral)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    both = text.select("cluster_id", F.col("centroid").alias("t")).join(spectral.select("cluster_id", F.col("centroid").alias("s")), "cluster_id")
    return _nearest(df, both, lambda c: alpha * cosine(text_vector, c["t"]) + (1 - alpha) * cosine(spectral_vector, c["s"]))



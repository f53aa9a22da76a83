"""§3: the end-to-end pipelines, with the command lines' parameters as keyword arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.functions.vector import unit
from paperloom.operators import graph, metrics, projection, relational, sampling, similarity, spectral
from paperloom.operators.composition import cluster_size_stats, cluster_sizes, composition, purity, purity_summary


def affinity(emb: DataFrame, graph_type: str = "knn", k_neighbors: int = 20, epsilon: float = 0.7) -> DataFrame:
    """The affinity graph of an embedding table by name; an unknown name is an error."""
    makers = {"knn": lambda: similarity.knn_graph_summed(emb, k_neighbors), "epsilon": lambda: similarity.epsilon_graph(emb, epsilon), "full": lambda: similarity.full_graph(emb, 0.01)}
    if graph_type not in makers:
        raise ValueError(f"graph_type is one of {sorted(makers)}, not {graph_type!r}")
    return scratch.staged(makers[graph_type](), "affinity")


def spectral_embeddings(emb: DataFrame, n_clusters: int = 40, graph_type: str = "knn", k_neighbors: int = 20, epsilon: float = 0.7, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.1: (node_id, class_idx, cluster_id) by spectral clustering of an affinity graph."""
    labels = spectral.spectral_cluster(affinity(emb, graph_type, k_neighbors, epsilon), n_clusters, n_init=n_init, seed=random_state)
    return emb.select("node_id", "class_idx").join(labels, "node_id")


def evaluate(assignments: DataFrame, emb: DataFrame | None = None) -> DataFrame:
    """One row: ARI, NMI, homogeneity, completeness, V, purity, cluster sizes, and the silhouette if vectors are given."""
    out = metrics.adjusted_rand(assignments)
    for part in (metrics.information_scores(assignments), purity_summary(purity(assignments)), cluster_size_stats(cluster_sizes(assignments))):
        out = out.crossJoin(F.broadcast(part))
    if emb is not None:
        out = out.crossJoin(F.broadcast(metrics.silhouette_sampled(assignments.join(emb.select("node_id", "embedding"), "node_id"))))
    return out


def minibatch_spectral(emb: DataFrame, n_clusters: int = 40, graph_k: int = 20, projection_k: int = 3, stratified_ratio: float = 0.1, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.2, one view of text: cluster a stratified sample, project the rest, assign it to the nearest centroid."""
    sample, rest = (scratch.staged(d, "part") for d in sampling.stratified_sample(emb, ratio=stratified_ratio, seed=random_state))
    matrix = scratch.staged(similarity.knn_graph_summed(sample, graph_k), "affinity")
    features = scratch.staged(spectral.eigenpairs(matrix, n_clusters)[1].select("node_id", unit("v").alias("features")), "features")
    labels = scratch.staged(spectral.kmeans(features, n_clusters, n_init=n_init, seed=random_state), "labels")
    cents = similarity.centroids(features.join(labels, "node_id"), "features")
    projected = projection.project_knn(rest, sample, features, projection_k)
    assigned = similarity.nearest_centroid(projected, cents, "features").select("node_id", "cluster_id")
    return relational.reconstruct_labels(labels, assigned, emb.select("node_id", "class_idx"))


def minibatch_citation(nodes: DataFrame, edges: DataFrame, n_clusters: int = 40, projection_k: int = 3, stratified_ratio: float = 0.1, include_neighbors: bool = False, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.2, one view of citations."""
    nodes = nodes.select("node_id", "class_idx")
    sample, rest = sampling.stratified_sample(nodes, ratio=stratified_ratio, seed=random_state)
    if include_neighbors:
        sample = sampling.expand_sample(sample, edges, nodes).drop("is_seed")
        rest = relational.without(nodes, sample)
    sample, rest = scratch.staged(sample, "part"), scratch.staged(rest, "part")
    matrix = scratch.staged(graph.citation_adjacency(relational.induced_edges(edges, sample), "unit", sample), "adjacency")
    features = scratch.staged(spectral.eigenpairs(matrix, n_clusters)[1].select("node_id", unit("v").alias("features")), "features")
    labels = scratch.staged(spectral.kmeans(features, n_clusters, n_init=n_init, seed=random_state), "labels")
    cents = similarity.centroids(features.join(labels, "node_id"), "features")
    projected = projection.project_citation(edges, rest, sample, features, projection_k)
    assigned = similarity.nearest_centroid(projected, cents, "features").select("node_id", "cluster_id")
    return relational.reconstruct_labels(labels, assigned, nodes)


def _cited_features(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """(node_id, features): the citation view: spectral features of the graph among these nodes, rows of length one."""
    matrix = scratch.staged(graph.citation_adjacency(relational.induced_edges(edges, nodes), "unit", nodes), "adjacency")
    return scratch.staged(spectral.spectral_features(matrix, dims, True), "features")


def multiview(emb: DataFrame, edges: DataFrame, n_clusters: int = 40, n_spectral_dims: int = 50, k_neighbors: int = 20, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.4: two-view clustering of text and citations over the nodes that both have."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    both = emb.join(ends, "node_id", "left_semi")
    text = scratch.staged(similarity.knn_graph_summed(both, k_neighbors), "text")
    features = _cited_features(edges, both, n_spectral_dims)
    cited = scratch.staged(similarity.knn_graph_summed(features.withColumnRenamed("features", "embedding"), k_neighbors), "cited")
    return both.select("node_id", "class_idx").join(spectral.multiview_cluster(text, cited, n_clusters, n_init=n_init, seed=random_state), "node_id")


def minibatch_multiview(emb: DataFrame, edges: DataFrame, n_clusters: int = 40, n_spectral_dims: int = 50, graph_k: int = 20, projection_k: int = 3, alpha: float = 0.5, stratified_ratio: float = 0.1, include_neighbors: bool = True, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.2: two views of a sample, the rest assigned by the blended similarity to centroids in both; rows are matched by node_id throughout (Q20)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    emb = emb.select("node_id", "class_idx", "embedding")
    sample, rest = sampling.stratified_sample(emb, ratio=stratified_ratio, seed=random_state)
    if include_neighbors:
        sample = sampling.expand_sample(sample, edges, emb).drop("is_seed")
        rest = relational.without(emb, sample)
    sample, rest = scratch.staged(sample, "part"), scratch.staged(rest, "part")
    features = _cited_features(edges, sample, n_spectral_dims)
    cited = scratch.staged(similarity.knn_graph_summed(features.withColumnRenamed("features", "embedding"), graph_k), "cited")
    text = scratch.staged(similarity.knn_graph_summed(sample, graph_k), "text")
    labels = scratch.staged(spectral.multiview_cluster(text, cited, n_clusters, n_init=n_init, seed=random_state), "labels")
    rows = sample.select("node_id", unit("embedding").alias("embedding")).join(labels, "node_id").join(features, "node_id")
    by_text, by_cited = similarity.centroids(rows), similarity.centroids(rows, "features")
    projected = projection.project_citation(edges, rest, sample, features, projection_k)
    assigned = similarity.blended_centroid(rest.join(projected, "node_id"), by_text, by_cited, alpha).select("node_id", "cluster_id")
    return relational.reconstruct_labels(labels, assigned, emb.select("node_id", "class_idx"))


def citation_spectral(nodes: DataFrame, edges: DataFrame, n_clusters: int | None = None, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """Spectral clustering of the citation graph; as many clusters as classes by default."""
    k = n_clusters or nodes.select("class_idx").distinct().count()
    labels = spectral.spectral_cluster(scratch.staged(graph.citation_adjacency(edges, "keep"), "adjacency"), k, n_init=n_init, seed=random_state)
    return nodes.select("node_id", "class_idx").join(labels, "node_id")


def hybrid(nodes: DataFrame, edges: DataFrame, emb: DataFrame, n_clusters: int = 40, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """§3.3: spectral clustering of citations weighted by the cosine of their ends; negative weights count as 0."""
    known = relational.bridge_ids(edges, nodes, emb)
    matrix = scratch.staged(graph.weighted_adjacency(known, emb, clamp=True), "weighted")
    if matrix.isEmpty():
        raise ValueError("no edge has vectors at both ends")
    labels = spectral.spectral_cluster(matrix, n_clusters, n_init=n_init, seed=random_state)
    return nodes.select("node_id", "class_idx").join(labels, "node_id")


def kmeans_embeddings(emb: DataFrame, k: int, n_init: int = 10, random_state: int = 42) -> DataFrame:
    """k-means on the vectors themselves."""
    return emb.select("node_id", "class_idx").join(spectral.kmeans(emb, k, "embedding", n_init=n_init, seed=random_state), "node_id")


def eigen_gap_analysis(matrix: DataFrame, max_k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(gap table, statistics) of an affinity matrix; max_k is at most a tenth of the nodes."""
    n = matrix.select("i").distinct().count()
    max_k = max(1, min(max_k, n // 10))
    values = spectral.eigenvalue_frame(matrix.sparkSession, spectral.eigenpairs(matrix, max_k + 5)[0])
    gaps = spectral.eigen_gaps(values, max_k)
    return spectral.eigen_gap_table(gaps), spectral.gap_statistics(values, gaps)


def cluster_report(assignments: DataFrame) -> DataFrame:
    """The composition table that the pipelines exchange."""
    return composition(assignments)

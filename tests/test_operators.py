"""Invariants, published figures and edge cases."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions import vector as vec
from paperloom.operators import composition as co
from paperloom.operators import graph as gr
from paperloom.operators import metrics as me
from paperloom.operators import projection as pr
from paperloom.operators import relational as rl
from paperloom.operators import sampling as sa
from paperloom.operators import similarity as si
from paperloom.operators import spectral as sp
from paperloom.operators import vectorize as ve
from paperloom.plans import pipelines as pl
from paperloom.sources import readers, writers
from paperloom.streaming.assign import assign_stream, windowed_counts


def labels(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "node_id long, class_idx int, cluster_id int")


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "node_id long, embedding array<double>")


def test_published_cluster_sizes(spark):
    sizes = spark.createDataFrame([(i, s) for i, s in enumerate([6553, 375, 18177, 1968, 264, 36, 194, 203])], "cluster_id int, size long")
    r = co.cluster_size_stats(sizes).first()
    assert (r.largest, r.smallest, r.mean_size) == (18177, 36, 3471.25) and abs(r.std_size - 5927.815907861849) < 1e-6


def test_scores_of_equal_and_renamed_labels(spark):
    same = labels(spark, [(i % 3, (i + 1) % 3 * 7) for i in range(30)])
    assert me.adjusted_rand(same).first().ari == 1.0
    s = me.information_scores(same).first()
    assert all(abs(x - 1) < 1e-12 for x in s)
    one = labels(spark, [(0, 0)] * 5)
    assert me.adjusted_rand(one).first().ari == 1.0 and me.information_scores(one).first().nmi == 1.0


def test_nmi_is_v_measure(spark):
    r = me.information_scores(labels(spark, [(i % 4, i % 3) for i in range(50)])).first()
    assert abs(r.nmi - r.v_measure) < 1e-12 and 0 <= r.nmi <= 1


def test_purity_tie_goes_to_the_smallest_class(spark):
    r = {x.cluster_id: x for x in co.purity(labels(spark, [(5, 1), (2, 1), (9, 2)])).collect()}
    assert (r[1].dominant_class, r[1].purity, r[2].purity) == (2, 0.5, 1.0)


def test_composition_adds_up(spark):
    c = co.composition(labels(spark, [(i % 5, i % 2) for i in range(40)]))
    assert all(abs(x[1] - 100) < 1e-9 for x in c.groupBy("cluster_id").agg(F.sum("percentage_in_cluster")).collect())
    n = co.nested_composition(c).first()
    assert n.total_papers == sum(n.class_counts.values()) and n.num_different_classes == len(n.class_counts)


def test_top3_pads_small_clusters(spark):
    names = readers.default_categories(spark)
    r = co.top3_wide(co.composition(labels(spark, [(99, 1), (99, 1), (3, 1)])), names).first()
    assert (r.top1_category, r.top2_category, r.top3_category, r.top3_count, r.other_count) == ("Unknown_99", "cs.CY", "None", 0, 0)
    assert len(r) == 18


def test_silhouette(spark):
    x = [[0, 0], [0, 1], [5, 5], [5, 6], [9, 0]]
    df = vectors(spark, x).join(spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "node_id long, cluster_id int"), "node_id")
    got = {r.node_id: r.silhouette for r in me.silhouette_values(df, block=2).collect()}
    d = np.linalg.norm(np.array(x)[:, None] - np.array(x)[None], axis=2)
    b0 = min(d[0, 2:4].mean(), d[0, 4])
    assert abs(got[0] - (b0 - d[0, 1]) / max(b0, d[0, 1])) < 1e-9 and got[4] == 0
    assert me.silhouette(df.withColumn("cluster_id", F.lit(1))).first().silhouette is None


def test_knn_ties_duplicates_and_zero_vectors(spark):
    df = vectors(spark, [[1, 0], [1, 0], [0, 1], [0, 0], [1, 1]])
    got = {(r.i, r["rank"]): r.j for r in si.knn(df, 2).collect()}
    assert got[0, 1] == 1 and got[1, 1] == 0 and got[3, 1] == 0 and got[3, 2] == 1
    assert all(i != j for (i, _), j in got.items())
    small = {(r.i, r["rank"]): r.j for r in si.knn(df, 2, block=2).collect()}
    assert small == got
    assert si.knn(df.limit(0), 2).count() == 0


def test_affinities_are_symmetric(spark):
    rng = np.random.default_rng(0)
    df = vectors(spark, rng.standard_normal((30, 4)))
    for m in (si.knn_graph_assigned(df, 3), si.knn_graph_summed(df, 3), si.epsilon_graph(df, 0.2), si.full_graph(df)):
        assert gr.asymmetry(m).first()[0] < 1e-10
    with pytest.raises(ValueError):
        pl.affinity(df, "other")


EDGES = [(1, 1), (1, 2), (1, 2), (3, 4), (4, 3), (5, 6)]


def test_adjacency_options(spark):
    e = spark.createDataFrame(EDGES, "source long, target long")
    n = spark.range(1, 10).withColumnRenamed("id", "node_id")
    w = {o: {(r.i, r.j): r.w for r in gr.citation_adjacency(e, o, n).collect()} for o in ("keep", "drop", "unit")}
    assert w["keep"][1, 1] == 1 and w["keep"][1, 2] == 2 and w["keep"][3, 4] == 2
    assert (1, 1) not in w["drop"] and w["unit"][9, 9] == 1.0
    assert set(r.w for r in gr.citation_adjacency(e, "keep", binary=True).collect()) == {1.0}
    with pytest.raises(ValueError):
        gr.citation_adjacency(e, "other")
    assert gr.citation_adjacency(e.limit(0)).count() == 0


def test_components_and_zero_eigenvalues(spark):
    e = spark.createDataFrame(EDGES, "source long, target long")
    n = spark.range(1, 8).withColumnRenamed("id", "node_id")
    comp = gr.components(e, n)
    assert {r.node_id: r.component for r in comp.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    s = gr.component_summary(comp).first()
    assert (s.connected, s.n_components, s.largest) == (False, 4, 2)
    values, _ = sp.eigenpairs(gr.citation_adjacency(e, "unit", n), 7)
    assert sum(v < 1e-8 for v in values) == 4


def test_long_path_is_one_component(spark):
    e = spark.range(0, 400).selectExpr("id as source", "id + 1 as target")
    assert {r.component for r in gr.components(e, spark.range(401).withColumnRenamed("id", "node_id")).collect()} == {0}


def test_eigenpairs_dense_and_iterated_agree(spark):
    rng = np.random.default_rng(1)
    m = si.knn_graph_summed(vectors(spark, np.concatenate([rng.standard_normal((12, 3)) * 0.2 + c for c in ([3, 0, 0], [0, 3, 0], [0, 0, 3])])), 4)
    dense, rows = sp.eigenpairs(m, 3)
    iterated, _ = sp.eigenpairs(m, 3, dense=0, steps=40, tol=1e-5)
    assert np.allclose(dense, iterated, atol=1e-3)
    assert rows.count() == 36


def random_graph(spark, n, m, seed):
    e = np.random.default_rng(seed).integers(0, n, (m, 2))
    e = {(int(a), int(b)) for a, b in e if a != b} | {(i, (i + 1) % n) for i in range(n)}
    return spark.createDataFrame([(*x, 1.0) for x in {y for a, b in e for y in ((a, b), (b, a))}], "i long, j long, w double")


def test_iterated_eigenvectors_of_close_values(spark):
    m = random_graph(spark, 300, 1500, 2)
    dense, rows = sp.eigenpairs(m, 5)
    iterated, found = sp.eigenpairs(m, 5, dense=0)
    assert np.allclose(dense, iterated, atol=1e-8)
    a, b = (np.array([r.v for r in sorted(x.collect(), key=lambda r: r.node_id)]) for x in (rows, found))
    assert np.linalg.svd(a.T @ b)[1].min() > 1 - 1e-6
    with pytest.raises(RuntimeError, match="converge"):
        sp.eigenpairs(m, 5, dense=0, steps=1)


def test_spectral_clustering_finds_blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((15, 3)) * 0.1 + c for c in ([3, 0, 0], [0, 3, 0], [0, 0, 3])])
    emb = vectors(spark, x).withColumn("class_idx", (F.col("node_id") / 15).cast("int"))
    assert me.adjusted_rand(pl.spectral_embeddings(emb, 3, k_neighbors=5, n_init=2)).first().ari == 1.0
    assert me.adjusted_rand(pl.kmeans_embeddings(emb, 3, n_init=2)).first().ari == 1.0
    spread = emb.select("class_idx", "node_id").join(sp.kmeans(emb, 3, "embedding", n_init=2, dense=0), "node_id")
    assert me.adjusted_rand(spread).first().ari == 1.0


def test_cotraining_beyond_the_dense_bound(spark, monkeypatch):
    seen = {}

    def keep(rows, *_, **__):
        return seen.setdefault("x", np.array([r.features for r in sorted(rows.collect(), key=lambda r: r.node_id)]))

    monkeypatch.setattr(sp, "kmeans", keep)
    a, b = random_graph(spark, 60, 200, 4), random_graph(spark, 60, 260, 5)
    dots = []
    for bound in (3000, 10):
        monkeypatch.setattr(sp, "DENSE", bound)
        seen.clear()
        sp.multiview_cluster(a, b, 3, rounds=2)
        dots.append(seen["x"] @ seen["x"].T)  # the same whatever the vectors' signs
    assert np.allclose(dots[0], dots[1], atol=1e-4)


def test_gaps_with_several_zero_eigenvalues(spark):
    v = sp.eigenvalue_frame(spark, [0, 0, 0.01, 0.05, 0.3, 0.32, 0.9])
    g = sp.eigen_gaps(v)
    assert [r.k for r in sp.eigen_gap_table(g).where("is_optimal").collect()] == [2]
    assert g.where("k = 1").first().relative_gap == 0


def test_samples_are_exact_and_repeatable(spark):
    n = spark.range(200).selectExpr("id as node_id", "cast(id % 7 as int) as class_idx")
    a, rest = sa.stratified_sample(n, n=50)
    assert a.count() == 50 and a.intersect(rest).count() == 0 and a.union(rest).distinct().count() == 200
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in sa.stratified_sample(n.repartition(5), n=50)[0].collect()}
    assert sa.stratified_sample(n, n=500)[1].count() == 0
    lone = n.unionByName(spark.createDataFrame([(999, 99)], "node_id long, class_idx int"))
    assert sa.stratified_sample(lone, n=20)[0].count() == 20


def test_projection_weights(spark):
    e = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (2, 11)], "source long, target long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id long")
    w = pr.citation_weights(e, ids(1, 99), ids(2, 3), 2)
    got = {(r.i, r.j): r.weight for r in w.collect()}
    assert got == {(1, 2): 1.0, (99, 2): 0.5, (99, 3): 0.5}
    f = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "node_id long, features array<double>")
    assert {r.node_id: r.features for r in pr.weighted_mean(w, f).collect()} == {1: [1.0, 0.0], 99: [0.5, 0.5]}


def test_nearest_centroid_tie_and_zero(spark):
    c = spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 0.0])], "cluster_id int, centroid array<double>")
    got = {r.node_id: r.cluster_id for r in si.nearest_centroid(vectors(spark, [[3, 0], [0, 0]]), c).collect()}
    assert got == {0: 2, 1: 2}
    with pytest.raises(ValueError):
        si.blended_centroid(vectors(spark, [[1, 0]]), c, c, 1.5)


def test_bridge(spark):
    e = spark.createDataFrame([(101, 102)], "source long, target long")
    n = spark.createDataFrame([(1, 101), (2, 102), (3, None)], "node_id long, mag_paper_id long")
    emb = vectors(spark, [[1, 0], [0, 1], [1, 1]])
    assert [tuple(r) for r in rl.bridge_ids(e, n, emb).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        rl.bridge_ids(spark.createDataFrame([(7, 8)], "source long, target long"), n, emb)


def test_text_functions(spark):
    df = spark.createDataFrame([("The cat, and a  DOG: it runs!", r"On \emph{x} $y$ {z}")], "a string, b string")
    r = df.select(tx.remove_stop_words("a").alias("s"), tx.tokenize_alpha("a").alias("t"), tx.clean_latex("b").alias("l"), tx.word_overlap("a", "a").alias("o"), tx.lookup({"k": 1}, F.lit("z"), F.lit(7)).alias("d"), tx.combine_fields("a", F.lit(None), F.lit("Au"), "combined").alias("c")).first()
    assert r.s == "cat, dog: runs!" and r.t == ["cat", "dog", "runs"] and r.l == "On z" and r.o == 1 and r.d == 7 and r.c.endswith(" [AUTHORS] Au")
    with pytest.raises(ValueError):
        tx.combine_fields("a", "a", "a", "other")


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<double>, z array<double>, s array<array<double>>, m array<int>")
    r = df.select(vec.unit("a").alias("u"), vec.unit("z").alias("z"), vec.cosine("a", "z").alias("c"), vec.masked_mean("s", "m").alias("m"), vec.rescale(F.lit(0.0)).alias("r")).first()
    assert r.u == [0.6, 0.8] and r.z == [0, 0] and r.c == 0 and r.m == [2.0, 3.0] and r.r == 0.5


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight for r in ve.tfidf(df).collect()}
    a, b = 2 * (np.log(4 / 2) + 1), np.log(4 / 3) + 1
    assert abs(got[1, "aa"] - a / np.hypot(a, b)) < 1e-12 and len(got) == 4


def test_embedder_gives_zeros_for_empty_texts(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None), (3, " ")], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in ve.embed(df, ve.hashing_embedder(8), 8).collect()}
    assert any(got[1]) and not any(got[2]) and not any(got[3])


def test_files(spark, tmp_path):
    p = tmp_path / "e.txt.gz"
    p.write_bytes(gzip.compress(b"# c\n1 2\n\n3\t4 x\n5\n"))
    assert sorted(tuple(r) for r in readers.read_edge_text(spark, str(p)).collect()) == [("1", "2"), ("3", "4")]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("x/1.abs", b"Paper: p1\nTitle: old\nAuthors: A\nAbstract: b\\\\"), ("x/2.abs", b"Paper: p1\nTitle: new\xff\nAuthors: A\nAbstract: b\\\\"), ("x/skip.txt", b"Paper: no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert [(r.paper_id, r.title) for r in readers.read_abstract_archives(spark, str(tmp_path / "a.tar.gz")).collect()] == [("p1", "new")]
    m = np.array([[0.5, 1.5, 7, 2], [2.5, 3.5, 8, 3]], dtype=np.float32)
    np.save(tmp_path / "m.npy", m)
    assert [(r.node_id, r.class_idx, r.embedding) for r in readers.read_packed(spark, str(tmp_path / "m.npy"), 2, block_rows=1).orderBy("node_id").collect()] == [(7, 2, [0.5, 1.5]), (8, 3, [2.5, 3.5])]
    with pytest.raises(Exception, match="expected 5"):
        readers.read_packed(spark, str(tmp_path / "m.npy"), 3).collect()
    writers.write_npy(readers.read_matrix(spark, str(tmp_path / "m.npy")), str(tmp_path / "n.npy"))
    assert np.array_equal(np.load(tmp_path / "n.npy"), m)
    (tmp_path / "map.csv").write_text("Label Idx,ArXiv Category\n0, cs.AA \n1,cs.BB\n")
    assert [tuple(r) for r in readers.read_category_map(spark, str(tmp_path / "map.csv")).orderBy("class_id").collect()] == [(0, "cs.AA"), (1, "cs.BB")]
    assert readers.read_label_map(spark).count() == 40 and readers.read_label_map(spark, str(tmp_path / "map.csv")).orderBy("class_id").first().class_id == 0
    assert spark.createDataFrame([("arxiv cs lg",)], "c string").select(readers.normal_category(F.col("c"))).first()[0] == "cs.LG"
    with pytest.raises(FileNotFoundError, match="nothere"):
        readers.exists(spark, str(tmp_path / "map.csv"), str(tmp_path / "nothere"))
    nodes, edges = spark.createDataFrame([(1, 'a<"&')], "node_id long, title string"), spark.createDataFrame([(1, 1), (1, 1)], "source long, target long")
    writers.write_graphml(nodes, edges, str(tmp_path / "g.graphml"), ["title"])
    import xml.etree.ElementTree as et

    root = et.parse(tmp_path / "g.graphml").getroot()
    assert len(root.findall(".//{*}node")) == 1 and len(root.findall(".//{*}edge")) == 1 and root.find(".//{*}data").text == 'a<"&'
    assert json.loads(writers.dumps({1: np.float64(2), "a": [np.int64(3)]})) == {"1": 2.0, "a": [3]}
    writers.write_csv(nodes, str(tmp_path / "c"), one_file=True)
    assert readers.read_csv(spark, str(tmp_path / "c"), "node_id long, title string").first().title == 'a<"&'


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, title string")
    assert [r.title for r in rl.fill_defaults(df, {"title": "Missing title", "abstract": ""}).orderBy("id").collect()] == ["Missing title", "x"]
    with pytest.raises(ValueError, match="abstract"):
        rl.require_columns(df, ["abstract"])
    assert rl.resolve_column(df, ["paper title", "Title"]) == "title" and rl.resolve_column(df, ["zzz"]) is None
    assert rl.left_join_suffixed(df, df, "id").columns == ["id", "title_x", "title_y"]
    assert rl.reorder(df, ["title"]).columns == ["title", "id"]
    assert rl.last_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string"), "k", "o").first().v == "b"
    ix = rl.dense_index(spark.createDataFrame([(x,) for x in (30, 10, 20)], "node_id long"), "node_id")
    assert {r.node_id: r.idx for r in ix.collect()} == {10: 0, 20: 1, 30: 2}


def test_streams(spark, tmp_path):
    vectors(spark, [[1, 0], [0, 2]]).write.parquet(str(tmp_path / "v"))
    stream = assign_stream(spark.readStream.schema("node_id long, embedding array<double>").parquet(str(tmp_path / "v")), [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    q = stream.select("node_id", "cluster_id").writeStream.format("memory").queryName("assigned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("assigned").collect()} == {(0, 0), (1, 1)}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "t string, event_type string, value double").selectExpr("cast(t as timestamp) as ts", "event_type", "value")
    r = windowed_counts(events).first()
    assert (r.n, r.total) == (2, 3.0)


def test_model_embedders_pool_as_their_models_do(spark):
    import numpy as np

    from paperloom.operators import vectorize as ve

    hidden = np.array([[[1.0, -1.0], [3.0, 5.0], [9.0, 9.0]]])
    mask = np.array([[1, 1, 0]])
    assert ve.pool(hidden, mask, "cls").tolist() == [[1, -1]]
    assert ve.pool(hidden, mask, "masked_mean").tolist() == [[2, 2]]
    assert ve.pool(hidden, mask, "mean").round(6).tolist() == [[4.333333, 4.333333]]
    assert np.allclose(ve.pool(hidden, mask, "splade"), np.log1p([[3, 5]]))

    def load():
        def tokenize(texts, most, padded):
            words = [t.split()[:most] for t in texts]
            width = most if padded else max(map(len, words))
            return np.array([[len(x) for x in w] + [0] * (width - len(w)) for w in words]), np.array([[1] * len(w) + [0] * (width - len(w)) for w in words])

        return tokenize, lambda ids, mask: np.stack([ids, ids * 2.0], axis=2)

    df = spark.createDataFrame([(1, "a bbb"), (2, None), (3, "cc")], "doc_id long, text string")
    got = {r.doc_id: list(r.embedding) for r in ve.embed(df, ve.model_embedder(load, "bert"), 2).collect()}
    assert got == {1: [2, 4], 2: [0, 0], 3: [2, 4]}
    assert {r.doc_id: list(r.embedding) for r in ve.embed(df, ve.model_embedder(load, "distilbert", max_tokens=4), 2).collect()} == {1: [1, 2], 2: [0, 0], 3: [0.5, 1]}
    assert [ve.batch_for_memory(g) for g in (80, 40, 24, 12, 4, None)] == [32, 32, 16, 12, 8, 8]


def test_tsne_keeps_groups_apart():
    import numpy as np

    from paperloom.operators.vectorize import tsne

    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((30, 8)) * 0.2 + 4 * np.eye(8)[k] for k in range(3)])
    y = tsne(x, 10)
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert (d.argmin(1) // 30 == np.arange(90) // 30).all()
    assert np.allclose(tsne(x, 10), y) and tsne(x[:1], 1).shape == (1, 2)


def test_dense_tfidf_puts_the_id_over_a_term_of_its_name(spark):
    from paperloom.operators.vectorize import dense_tfidf

    df = spark.createDataFrame([(1, "id word word"), (2, ""), (3, None)], "doc_id long, text string")
    wide = dense_tfidf(df)
    assert wide.columns == ["word", "id"]
    assert sorted((r.id, round(r.word, 6)) for r in wide.collect()) == [(1, 0.894427), (2, 0.0), (3, 0.0)]

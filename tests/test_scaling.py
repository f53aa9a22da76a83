"""Steps whose cost must not grow faster than their input: the way they are computed, and the same results."""

import gzip
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import metrics as me
from paperloom.operators import relational as rl
from paperloom.operators import similarity as si
from paperloom.operators import spectral as sp
from paperloom.operators import strips as st
from paperloom.operators import vectorize as ve
from paperloom.sources import readers, writers


def ring(spark, n):
    """The normalised Laplacian of a ring of n nodes; its eigenvalues are 1 - cos(2 pi k / n)."""
    e = [(i, (i + s) % n, -0.5) for i in range(n) for s in (1, n - 1)] + [(i, i, 1.0) for i in range(n)]
    return spark.createDataFrame(e, "i long, j long, w double")


def test_strips_multiply_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(st, "LEAST", 100)
    monkeypatch.setattr(st, "BLOCK_BYTES", 800)  # several blocks a strip
    n, p = 200, 3
    s = st.Strips(ring(spark, n), p)
    assert s.tasks > 1 and s.per > 1
    x = s.start(p, 1)
    ids = {r["block"]: np.frombuffer(r["ids"], np.int64) for r in s.ids.collect()}
    dense = np.zeros((n, p))
    for r in x.collect():
        dense[ids[r["block"]]] = np.frombuffer(r["v"]).reshape(-1, p)
    assert np.ptp(dense) > 1
    both, g = s.ritz(x, np.eye(p))
    plan = s._product(x, np.eye(p), None, "block int")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
    want = dense - (np.roll(dense, 1, axis=0) + np.roll(dense, -1, axis=0)) / 2
    for r in both.collect():
        assert np.allclose(np.frombuffer(r["lv"]).reshape(-1, p), want[ids[r["block"]]], atol=1e-12)
    side = np.concatenate([dense, want], axis=1)
    assert np.allclose(g, side.T @ side)
    s.close()


def test_filter_of_zeros_is_the_chebyshev_polynomial():
    zeros, x = st.chebyshev_zeros(20, 1.2, 0.8), np.array([0.0, 0.3, 0.5, 1.2, 1.9])
    y = (x - 1.2) / 0.8
    want = np.where(np.abs(y) <= 1, np.cos(20 * np.arccos(np.clip(y, -1, 1))), np.cosh(20 * np.arccosh(np.maximum(np.abs(y), 1)))) * 2.0
    got = np.ones(len(x))
    for z in zeros:
        got = got * (x - z) / 0.4
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_eigenpairs_of_a_ring(spark):
    values, rows = sp._iterate(ring(spark, 60), 5, 50, 42, 1e-6)
    assert np.allclose(values, [1 - np.cos(2 * np.pi * k / 60) for k in (0, 1, 1, 2, 2)], atol=1e-9)
    v = np.array([r.v for r in rows.orderBy("node_id").collect()])
    assert v.shape == (60, 5) and np.allclose(v.T @ v, np.eye(5), atol=1e-9)
    assert rows.select(F.countDistinct("node_id")).first()[0] == 60


def test_blocks_meet_without_being_copied(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.standard_normal((300, 4)).repeat(2, axis=0))]
    df = spark.createDataFrame(rows, "node_id long, embedding array<double>")

    def kernel(l, r):  # noqa: E741
        import pyarrow as pa

        yield pa.table({"n": [l.num_rows], "m": [r.num_rows]})

    pairs = si.block_pairs(df, df, kernel, "n long, m long", block=200)
    assert "CartesianProduct" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 9 and pairs.agg(F.sum(F.col("n") * F.col("m"))).first()[0] == 600**2
    # equal vectors are equally similar, in any blocks: of equals the smaller id
    x = np.array([r[1] for r in rows])
    sims = np.round(x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None], 12)
    np.fill_diagonal(sims, -2)
    for block in (None, 250):
        got = {(r.i, r["rank"]): r.j for r in si.knn(df, 3, block=block).collect()}
        want = {(i, k + 1): int(j) for i in range(600) for k, j in enumerate(np.lexsort((np.arange(600), -sims[i]))[:3])}
        assert got == want


def test_equal_titles_are_compared_once(spark):
    """Before, 4,000 titles of four kinds met in 4 million pairs."""
    names = ["red bolt", "red ring", "old bolt big", "Bolt RED"]
    df = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int")).alias("title"))
    rows = rl.match_titles(df, df)
    joined = [r.left_id for r in rows.collect()]
    assert len(joined) == 12000
    got = {i: [r.right_id for r in rows.where(f"left_id = {i}").orderBy(F.desc("overlap"), "right_id").collect()] for i in (3, 5, 3998)}
    assert got == {3: [0, 3, 4], 5: [1, 5, 9], 3998: [2, 6, 10]}
    assert rows.where("left_id % 4 = 2").agg(F.min("overlap")).first()[0] == 1.0
    titles = [p for p in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in p]
    assert titles and not any("left_id" in p and "word#" in p for p in titles)


def test_graphml_is_put_together_from_files(spark, tmp_path):
    nodes = spark.range(50).select(F.col("id").alias("node_id"), F.concat(F.lit("a & "), "id").alias("title"))
    edges = spark.range(50).select(F.col("id").alias("source"), (49 - F.col("id")).alias("target"))
    before = writers.DataFrame.toLocalIterator
    try:
        writers.DataFrame.toLocalIterator = None  # no rows go through the driver
        writers.write_graphml(nodes, edges, str(tmp_path / "g"), ["title"])
    finally:
        writers.DataFrame.toLocalIterator = before
    lines = (tmp_path / "g").read_text().splitlines()
    assert lines[0].startswith("<?xml") and lines[-2:] == ["</graph>", "</graphml>"]
    body = lines[4:-2]
    assert body == sorted(body, key=lambda x: (x.startswith("<edge"), x)) and len(body) == 100
    ET.parse(tmp_path / "g")


def test_ogb_folders_are_numbered_on(spark, tmp_path):
    for name, n in (("node-feat", 3), ("node-label", 2), ("edge", 2)):
        folder = tmp_path / f"{name}.csv.gz"
        folder.mkdir()
        rows = [f"{i}.0,{i}.5" if name == "node-feat" else f"{i % 7}" if name == "node-label" else f"{i},{i + 1}" for i in range(60)]
        cuts = [0, 5, 55, 60] if n == 3 else [0, 40, 60]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            with gzip.open(folder / f"part-{k}.gz", "wt") as f:
                f.write("\n".join(rows[a:b]) + "\n")
    nodes, edges = readers.read_ogb(spark, str(tmp_path))
    assert sorted((r.node_id, r.class_idx, tuple(r.embedding)) for r in nodes.collect()) == [(i, i % 7, (float(i), i + 0.5)) for i in range(60)]
    assert edges.count() == 60


def test_silhouette_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, i % 3, [float(i % 3), float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "node_id long, cluster_id int, embedding array<double>").mapInArrow(count, "node_id long, cluster_id int, embedding array<double>")
    assert me.silhouette_values(df, block=11).count() == 30 and seen.value == 30


def test_tfidf_reads_the_counts_once_for_weights(spark):
    df = spark.createDataFrame([(1, "ab ab cd"), (2, "cd ef"), (2, "ef")], "doc_id long, text string")
    out = ve.tfidf(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "tf#" in line for line in plan.split("\n")) == 2  # the vocabulary and the weights
    assert all(abs(r[0] - 1) < 1e-12 for r in out.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight"))).select(F.col("sum((weight * weight))")).collect())

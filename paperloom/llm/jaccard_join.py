"""Operator 9: Jaccard self-join on word n-grams with Bayesian candidate pruning.

A document is the set of its lower-cased word five-grams (all its words if
they are fewer). Documents with equal sets form a class, and only one of each
class goes on. Bands of MinHash values give candidates: documents that share a
band are linked to its smallest one, and connected documents form a cluster.
Each cluster is compared in blocks: MinHash values are compared a few at a
time, and after each step a pair is dropped when the posterior probability
that its similarity reaches the threshold, under a uniform prior, falls below
``tolerance``. What is left is verified exactly on the sets.

Clusters of more than ``BLOCK`` classes, or with many n-grams, are split into
chunks and compared as pairs of chunks, each in a task of its own; counts of
links and a spanning star leave a block, never all its pairs. Text is moved
only for the documents that a bitmap of bounded size says are in a cluster.

Null, empty and blank texts have no n-grams and link with nothing. Rows with
the same id count as one document; a null id is a document of its own that
links with nothing. Ties in similarity do not matter: all pairs at or above
the threshold are links, and the smallest id of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.llm.embedding_dedup import grouped
from paperloom.llm.line_dedup import _mix
from paperloom.llm.shared import deal_blocks, fresh, key_bitmap, maybe_in, text_batches
from paperloom.operators.components import connected_components

BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
#: Values that pruning looks at, and how many at a time.
SIGNS, STEP = 120, 24
#: Classes and n-grams of a chunk, at most (one large document may have more n-grams).
BLOCK, BLOCK_GRAMS = 256, 400_000
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += _mix(h[k : len(words) - n + 1 + k] * _C[k] + np.uint64(k))
    return np.unique(_mix(total))


def minhash(g: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(g), 2048):
        np.minimum(out, (g[i : i + 2048, None] * _A[:hashes] + _B[:hashes]).min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        x = _mix(x * _C[7] + sig[k::ROWS])
    return x.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n MinHash values with which a pair goes on.

    With m matches and a uniform prior, the similarity follows Beta(m + 1,
    n - m + 1), so it reaches t with the chance that Binomial(n + 1, t) <= m.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _texts(b: pa.RecordBatch, k: int) -> list[str]:
    return pc.fill_null(b.column(k).cast(pa.string()), "").to_pylist()


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s1, s2, size, band = [], [], [], []
            for t in _texts(b, 1):
                g = grams(t, n)
                size.append(len(g))
                if len(g):
                    s1.append(int(g.sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(_mix(g + _C[9]).sum(dtype=np.uint64).view(np.int64)))
                    band.append(bands(minhash(g)))
                else:
                    s1.append(None), s2.append(None), band.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["doc", "s1", "s2", "size", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [grams(t, n) for t in _texts(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(minhash(g, SIGNS) >> np.uint64(32)).astype(np.uint32).tobytes() for g in found], pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())], names=["doc", "sig", "grams"])

    return run


def block_pairs(sigs: np.ndarray, chunk: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that survive the pruning; of different chunks if the block holds two."""
    n = len(sigs)
    i, j = np.triu_indices(n, 1)
    if chunk[0] != chunk[-1]:
        apart = chunk[i] != chunk[j]
        i, j = i[apart], j[apart]
    matches = np.zeros(len(i), np.int64)
    for k in range(0, sigs.shape[1], STEP):
        for c in range(k, k + STEP):
            matches += sigs[i, c] == sigs[j, c]
        go = matches >= least_matches(k + STEP, threshold, tolerance)
        i, j, matches = i[go], j[go], matches[go]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have at least the threshold as their exact Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    if len(i) > 2 * len(sets):
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        common = np.flatnonzero(np.bincount(ids) > 1)
        place = np.full(ids.max() + 1, -1)
        place[common] = np.arange(len(common))
        row, col = np.repeat(np.arange(len(sets)), sizes), place[ids]
        row, col = row[col >= 0], col[col >= 0]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(common), 8192):
            inside = (col >= at) & (col < at + 8192)
            m = np.zeros((len(sets), min(8192, len(common) - at)), np.float32)
            m[row[inside], col[inside] - at] = 1
            both += m @ m.T
        shared = both[i, j].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # shared / (a + b - shared) >= t, without rounding up
    return shared >= np.ceil(threshold * (sizes[i] + sizes[j] - shared) - 1e-9)


def _links(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches, 3):
            rows = list({r["doc"]: r for r in rows}.values())
            chunk = np.array([r["chunk"] for r in rows])
            if len(rows) < 2 or rows[0]["one"] != rows[0]["two"] and chunk[0] == chunk[-1]:
                continue
            sigs = np.array([np.frombuffer(r["sig"], np.uint32) for r in rows])
            i, j = block_pairs(sigs, chunk, threshold, tolerance)
            if not len(i):
                continue
            ok = verified([np.frombuffer(r["grams"], np.uint64) for r in rows], i, j, threshold)
            i, j = i[ok], j[ok]
            weight = np.array([r["copies"] for r in rows])
            links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
            root = list(range(len(rows)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            out += [(rows[k]["doc"], rows[find(k)]["doc"], int(links[k])) for k in np.flatnonzero(links).tolist()]
            if len(out) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc", "root", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc", "root", "links"])

    return run


def similar_documents(df: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, component_id (smallest id reachable by links), n_links (documents linked directly) and kept, for every row."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the bands are laid out for thresholds from 0.5 on; recall at 0.8 is 0.999999")
    spark = df.sparkSession
    text_batches(spark)
    id_type = df.schema[doc_id].dataType.simpleString()
    base = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    profiles, profiles_path = scratch.stage(base.mapInArrow(_profiles(n), f"doc {id_type}, s1 bigint, s2 bigint, size bigint, bands array<bigint>"), "profiles")
    known = profiles.where("doc is not null and s1 is not null")
    repeated = profiles.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count() > 0
    if repeated:
        known = known.groupBy("doc").agg(F.min(F.struct("s1", "s2", "size", "bands")).alias("p")).select("doc", "p.*")
    classes = known.groupBy("s1", "s2", "size").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes, _ = scratch.stage(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    met, met_path = scratch.stage(met, "bands")
    stars = maybe_in(banded, "band", key_bitmap(met, "band")).where("maybe").join(met, "band").where("rep <> least").select("rep", "least").distinct()
    clusters = connected_components(stars, "rep", "least")
    scratch.drop(spark, met_path)
    members = clusters.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "size", "copies"), "rep")
    members, members_path = scratch.stage(members, "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("chunks"))
    rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0))).first()[0]
    split = members.join(sizes.drop("n"), "component").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = split.select(F.col("rep").alias("doc"), "component", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "copies")
    wanted, _ = scratch.stage(key_bitmap(members.select(F.xxhash64("rep").alias("key")), "key"), "wanted")
    asked = maybe_in(base.withColumn("_key", F.xxhash64("doc")), "_key", wanted).where("maybe").select("doc", "text")
    sets = asked.mapInArrow(_sets(n), f"doc {id_type}, sig binary, grams binary")
    if repeated:
        own = known.select(F.col("doc").alias("_d"), "size")
        sets = sets.join(own, (F.col("doc") == F.col("_d")) & (F.octet_length("grams") == F.col("size") * 8)).drop("_d", "size")
    dealt = deal_blocks(placed.join(sets, "doc").select("component", "one", "two", "chunk", "doc", "copies", "sig", "grams"), ["component"], rows, 2 * block)
    found, _ = scratch.stage(dealt.mapInArrow(_links(threshold, tolerance), f"doc {id_type}, root {id_type}, links bigint"), "links")
    scratch.drop(spark, members_path)
    groups = connected_components(found, "doc", "root").select(F.col("node").alias("rep"), "component")
    linked = found.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    whole = classes.select("s1", "s2", "size", "rep", "copies").join(linked, "rep", "left").join(groups, "rep", "left").select("s1", "s2", "size", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = profiles.select("doc", "s1", "s2", "size")
    some = known.select("doc", "s1", "s2", "size").join(whole, ["s1", "s2", "size"]).select("doc", "component_id", "n_links")
    if repeated:
        some = rows.where("s1 is not null and doc is not null").select("doc").join(some, "doc")
    alone = rows.where("s1 is null or doc is null").select("doc", F.col("doc").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(alone).select(F.col("doc").alias("doc_id"), "component_id", "n_links", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` without the documents that are not the smallest of their group."""
    mine = fresh(df.columns)
    key, lost, maybe = f"{mine}key", f"{mine}gone", f"{mine}maybe"
    gone, _ = scratch.stage(similar_documents(df, doc_id=doc_id, **options).where("not kept").select(F.col("doc_id").alias(lost), F.xxhash64("doc_id").alias(key)), "gone")
    asked = maybe_in(df.withColumn(key, F.xxhash64(F.col(doc_id))), key, key_bitmap(gone, key), name=maybe).drop(key)
    kept = asked.where(F.col(maybe)).join(gone.select(lost), F.col(doc_id) == F.col(lost), "left_anti")
    return asked.where(~F.col(maybe)).unionByName(kept).drop(maybe)

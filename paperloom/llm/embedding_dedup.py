"""Operator 2: near-duplicate vectors by randomised-rotation binary codes.

Each vector is scaled to length one and rotated at random; the signs of its
components are its binary code, and the inner product f of the code with the
rotated vector is its stored correction factor. The code stands at the angle
acos(f) from its vector, so a vector within the threshold's angle t of it is
within acos(f) + t of the code. Pairs whose code and vector are further apart
are dropped, which holds without exception; all others are computed exactly in
double precision. So every pair at the threshold or above is linked, and no other.

Equal vectors of a label form a class, and one of each class goes on with their
number as its weight, so copies are never compared. The vectors of a label are
dealt into chunks of about ``block``, and each pair of chunks is a task of its own;
within it only counts and a spanning star leave, never all pairs. The number of
compared codes grows with the square of a label's distinct vectors.

Vectors that are null, empty, zero, of another length than the label's
others, or hold null or non-finite components link with nothing, and neither
do those with a null label. Rows of the same id count as one vector (the
smallest by its values); a null id links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.llm.shared import deal_blocks
from paperloom.operators.components import connected_components


@lru_cache(maxsize=4)
def rotation(d: int, seed: int) -> np.ndarray:
    """A random rotation of d dimensions, kept by each worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def to_matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision, or None if it can't be compared."""
    out = []
    for v in column.to_numpy(zero_copy_only=False):
        if v is None or len(v) == 0:
            out.append(None)
            continue
        x = np.asarray(v, dtype=float)
        norm = np.linalg.norm(x) if np.isfinite(x).all() else 0.0
        out.append(x if norm > 0 and np.isfinite(norm) else None)
    return out


def encode_vectors(df: DataFrame, vec_id: str, vector: str, label: str, seed: int) -> DataFrame:
    """vec_id, label, unit vector (double), code and factor of all rows that can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = to_matrix(b.column(1))
            for d in sorted({len(x) for x in rows if x is not None}):
                at = [i for i, x in enumerate(rows) if x is not None and len(x) == d]
                x = np.array([rows[i] for i in at])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned = x @ rotation(d, seed)
                signs = turned >= 0
                factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([np.packbits(s).tobytes() for s in signs], pa.binary()), pa.array(factor)], names=names)

    names = ["vec_id", "label", "unit", "code", "factor"]
    id_type, label_type = df.schema[vec_id].dataType.simpleString(), df.schema[label].dataType.simpleString()
    return df.where(F.col(label).isNotNull()).select(vec_id, vector, label).mapInArrow(run, f"vec_id {id_type}, label {label_type}, unit binary, code binary, factor double")


def block_links(rows: list[dict], threshold: float, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, counting copies, smallest row number linked with it over any path) within a block.

    Rows of the same ``chunk`` are compared with each other if the block holds
    one chunk, otherwise those of one chunk with those of the other.
    """
    n = len(rows)
    unit = np.frombuffer(b"".join(r["unit"] for r in rows)).reshape(n, -1)
    d = unit.shape[1]
    chunk = np.array([r["chunk"] for r in rows])
    turned = unit @ rotation(d, rows[0]["seed"])
    signs = np.unpackbits(np.frombuffer(b"".join(r["code"] for r in rows), np.uint8).reshape(n, -1), axis=1)[:, :d]
    factor = np.array([r["factor"] for r in rows])
    # the least inner product with a row's code that a vector within the threshold can have, and some room for single precision
    within = np.arccos(np.clip(factor, -1, 1)) + math.acos(max(-1.0, min(1.0, threshold)))
    least = np.cos(np.minimum(math.pi, within)) - 1e-4
    codes = ((signs * 2.0 - 1) / math.sqrt(d)).astype(np.float32)
    weight = np.array([r["copies"] for r in rows])
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    apart = chunk[0] != chunk[-1]
    turned32 = turned.astype(np.float32)
    for lo in range(0, n, 256):
        mine = slice(lo, min(n, lo + 256))
        may = turned32[mine] @ codes.T >= least[None, :]
        may &= np.arange(n)[None, :] > np.arange(lo, mine.stop)[:, None]
        if apart:
            may &= chunk[mine][:, None] != chunk[None, :]
        i, j = np.nonzero(may)
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536] + lo, j[at : at + 65536]
            ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[ok], b[ok]
            if counts is not None:
                counts["exact"] = counts.get("exact", 0) + len(ok)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    return links, np.array([find(i) for i in range(n)])


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[dict]]:
    """Runs of rows with equal first ``key`` columns, from sorted batches."""
    held: list[dict] = []
    last = None
    for b in batches:
        names = b.schema.names[:key]
        for r in b.to_pylist():
            k = tuple(r[n] for n in names)
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(r)
    if held:
        yield held


def near_vectors(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 4096, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``df``."""
    spark = df.sparkSession
    id_type = df.schema[vec_id].dataType.simpleString()
    vectors = df.where(F.col(vec_id).isNotNull())
    if vectors.groupBy(vec_id).count().where("count > 1").limit(1).count():
        vectors = vectors.groupBy(vec_id).agg(F.min(F.struct(label, vector)).alias("_least")).select(vec_id, F.col(f"_least.{label}").alias(label), F.col(f"_least.{vector}").alias(vector))
    coded, coded_path = scratch.stage(encode_vectors(vectors, vec_id, vector, label, seed), "codes")
    named = coded.select("vec_id", "label", F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(7), "unit").alias("b"))
    classes = named.groupBy("label", "a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    copied = classes.where("copies > 1").limit(1).count() > 0
    one, one_path = coded.withColumn("copies", F.lit(1).cast("long")), None
    if copied:
        one, one_path = scratch.stage(coded.join(classes.select(F.col("rep").alias("vec_id"), "copies"), "vec_id"), "classes")
    wide = one.withColumn("width", F.length("unit"))
    sizes, sizes_path = scratch.stage(wide.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"), F.count("*").alias("n")), "sizes")
    placed = wide.join(sizes.drop("n"), ["label", "width"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0))).first()[0]
    dealt = deal_blocks(spread.select("label", "width", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "vec_id", "unit", "code", "factor", "copies"), ["label", "width"], rows, 2 * block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches, 4):
            if rows[0]["one"] != rows[0]["two"] and rows[0]["chunk"] == rows[-1]["chunk"]:
                continue
            rows[0]["seed"] = seed
            links, root = block_links(rows, threshold)
            out += [(rows[i]["vec_id"], rows[r]["vec_id"], k) for i, (r, k) in enumerate(zip(root.tolist(), links.tolist(), strict=True)) if k]
            if len(out) > 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["vec_id", "root", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["vec_id", "root", "links"])

    found, found_path = scratch.stage(dealt.mapInArrow(run, f"vec_id {id_type}, root {id_type}, links bigint"), "links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = connected_components(found, "vec_id", "root").withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    linked = counts.join(groups, "vec_id")
    if copied:
        # classes are dealt out anew, so that the join can be split where a large one meets
        rows = named.join(classes.repartition("rep"), ["label", "a", "b"]).select("vec_id", "rep", "copies").join(linked.withColumnRenamed("vec_id", "rep"), "rep", "left")
        linked, _ = scratch.stage(rows.select("vec_id", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "linked")
        scratch.drop(spark, one_path)
    for path in (coded_path, sizes_path):
        scratch.drop(spark, path)
    return df.select(F.col(vec_id).alias("vec_id")).join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))

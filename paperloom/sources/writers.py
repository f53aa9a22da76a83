"""Writers. Everything but the small driver-side exports is a distributed write."""

from __future__ import annotations

import json
import uuid
import xml.sax.saxutils as xml
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet_once(df: DataFrame, path: str) -> None:
    """K1: nothing happens where the path exists."""
    df.write.mode("ignore").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; ``one_file`` only for results known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def wide_vectors(df: DataFrame, dim: int, vector: str = "embedding", keep: Iterable[str] = ("node_id",)) -> DataFrame:
    """K5, P10: vector to columns dim_0 .. dim_{d-1}."""
    return df.select(*keep, *[F.get(vector, F.lit(i)).alias(f"dim_{i}") for i in range(dim)])


def write_npy(df: DataFrame, path: str, vector: str = "values", order: str = "row", max_rows: int = 200_000) -> None:
    """K3: a matrix in one local file, for at most ``max_rows`` rows; larger ones belong in Parquet."""
    import numpy as np

    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows; write more than {max_rows} as Parquet")
    np.save(path, np.array([r[0] for r in df.orderBy(order).select(vector).toLocalIterator()], dtype=np.float32))


def metrics_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """K6, K7."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A frame of one string column."""
    df.write.mode("overwrite").text(path)


def summary_lines(metrics: DataFrame) -> DataFrame:
    """``name: value`` lines of the numeric columns of a one-row frame."""
    numeric = [f.name for f in metrics.schema if isinstance(f.dataType, T.NumericType)]
    return metrics.select(F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in numeric])).alias("value"))


def graphml_elements(nodes: DataFrame, edges: DataFrame, attributes: list[str]) -> DataFrame:
    """K8: (part, value): GraphML elements, nodes in part 0 and edges in part 1."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = [F.concat(F.lit(f'<data key="{xml.escape(a)}">'), safe(a), F.lit("</data>")) for a in attributes]
    node = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), safe("node_id"), F.lit('">'), *data, F.lit("</node>")).alias("value"))
    edge = edges.select("source", "target").distinct().select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('"/>')).alias("value"))
    return node.unionByName(edge)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, attributes: list[str]) -> None:
    """K8: one local GraphML file. The elements are written by the executors, and their files, in order, put together as bytes."""
    from paperloom import scratch

    spark = nodes.sparkSession
    made = f"{scratch.folder(spark)}/graphml-{uuid.uuid4().hex}"
    write_text(graphml_elements(nodes, edges, attributes).orderBy("part", "value").select("value"), made)
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'<key id="{xml.escape(a)}" for="node" attr.name="{xml.escape(a)}" attr.type="string"/>\n' for a in attributes)
        f.write('<graph edgedefault="directed">\n')
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(made)) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    out = jvm.java.io.FileOutputStream(path, True)
    try:
        for part in found:
            data = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            finally:
                data.close()
    finally:
        out.close()
    scratch.drop(spark, made)
    with open(path, "a", encoding="utf-8") as f:
        f.write("</graph>\n</graphml>\n")


def native(x):
    """K6: numpy scalars and arrays in nested metrics as plain Python values."""
    if isinstance(x, dict):
        return {str(k): native(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [native(v) for v in x]
    return x.tolist() if hasattr(x, "tolist") else x


def dumps(metrics: dict) -> str:
    return json.dumps(native(metrics), indent=2, sort_keys=True)

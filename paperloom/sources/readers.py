"""Readers. Relational formats are native scans; archives and matrices are Python data sources."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom.functions.text import field
from paperloom.operators.relational import require_columns, resolve_column

#: Class index to category.
CATEGORIES = "cs.NA cs.MM cs.LO cs.CY cs.CR cs.DC cs.HC cs.CE cs.NI cs.CC cs.AI cs.MA cs.GL cs.NE cs.SC cs.AR cs.CV cs.GR cs.ET cs.SY cs.CG cs.OH cs.PL cs.SE cs.LG cs.SD cs.SI cs.RO cs.IT cs.PF cs.CL cs.IR cs.MS cs.FL cs.DS cs.OS cs.GT cs.DB cs.DL cs.DM".split()
#: The categories' full names, in the same order.
CATEGORY_NAMES = "Numerical Analysis|Multimedia|Logic in Computer Science|Computers and Society|Cryptography and Security|Distributed Computing|Human-Computer Interaction|Computational Engineering|Networking and Internet|Computational Complexity|Artificial Intelligence|Multiagent Systems|General Literature|Neural and Evolutionary Computing|Symbolic Computation|Hardware Architecture|Computer Vision|Graphics|Emerging Technologies|Systems and Control|Computational Geometry|Other Computer Science|Programming Languages|Software Engineering|Machine Learning|Sound|Social and Information Networks|Robotics|Information Theory|Performance|Computation and Language|Information Retrieval|Mathematical Software|Formal Languages|Data Structures and Algorithms|Operating Systems|Computer Science and Game Theory|Databases|Digital Libraries|Discrete Mathematics".split("|")


def exists(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError that names every missing path, in whatever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """S3: JSON lines; give a schema to spare a pass over the data."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV, compressed or not; quoted fields may hold line breaks only with ``multiLine``, which can't be split."""
    reader = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_positional(spark: SparkSession, path: str, names: list[str], **options) -> DataFrame:
    """Columns by position: the first ones get ``names``, the rest keep theirs."""
    df = read_csv(spark, path, **options)
    return df.toDF(*[names[i] if i < len(names) else c for i, c in enumerate(df.columns)])


def parse_edge_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Whitespace-separated pairs; blank lines and those that start with # are left out."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where((F.trim(F.col(line)) != "") & ~F.trim(F.col(line)).startswith("#"))
    return rows.select(parts.alias("p")).where(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("source"), F.get("p", F.lit(1)).alias("target"))


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """An edge list as text, gzip or plain."""
    return parse_edge_lines(spark.read.text(path))


def parse_blobs(blobs: DataFrame, content: str = "content", order: str | None = None) -> DataFrame:
    """paper_id, title, authors, abstract of metadata blobs; of a paper's blobs the last by ``order`` wins, as do all where there is no order and no repeat."""
    rows = blobs.select(*[field(content, k).alias(n) for k, n in (("paper", "paper_id"), ("title", "title"), ("authors", "authors"), ("abstract", "abstract"))], *([F.col(order).alias("_o")] if order else [])).where("paper_id is not null")
    if not order:
        return rows
    last = Window.partitionBy("paper_id").orderBy(F.desc("_o"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_o")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                for m in tar:
                    if m.isfile() and m.name.endswith(".abs"):
                        yield pd.DataFrame({"name": [f"{path}:{m.name}"], "content": [tar.extractfile(m).read().decode("utf-8", "ignore")]})


def read_abstract_archives(spark: SparkSession, path: str) -> DataFrame:
    """Tar archives of ``.abs`` files, one task an archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_blobs(files.mapInPandas(_members, "name string, content string"), order="name")


def read_label_map(spark: SparkSession, path: str | None = None, classes: int = 40) -> DataFrame:
    """class_id, category. The row's position is the key. Without a file, ``classes`` made-up names."""
    if path is None:
        return spark.range(classes).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("category_"), "id").alias("category"))
    df = read_csv(spark, path)
    name = resolve_column(df, ["arxiv category", "category", "label", "name"]) or df.columns[-1]
    rows = [r[0] for r in df.select(F.col(f"`{name}`").cast("string")).limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError(f"{path}: a label map has at most 10,000 rows")
    return spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "class_id int, category string")


def read_composition(spark: SparkSession, path: str) -> DataFrame:
    """The exchange table of cluster compositions."""
    return require_columns(read_csv(spark, path), ["cluster_id", "class_id", "paper_count"])


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """class_id, arxiv_category by column aliases, trimmed."""
    df = read_csv(spark, path)
    key = resolve_column(df, ["label idx", "label_idx", "class_id", "class_idx", "label", "idx"], required=True)
    name = resolve_column(df, ["arxiv category", "arxiv_category", "category", "name"], required=True)
    return df.select(F.col(f"`{key}`").cast("int").alias("class_id"), F.trim(F.col(f"`{name}`")).alias("arxiv_category"))


def normal_category(c) -> F.Column:
    """Without the prefix ``arxiv ``, blanks as dots, the part after the first dot in capitals: ``cs.LG``."""
    plain = F.regexp_replace(F.trim(F.lower(c)), r"^arxiv\s+", "")
    dotted = F.regexp_replace(plain, r"\s+", ".")
    return F.concat(F.substring_index(dotted, ".", 1), F.when(F.instr(dotted, ".") > 0, F.concat(F.lit("."), F.upper(F.substring_index(dotted, ".", -1)))).otherwise(""))


def default_categories(spark: SparkSession) -> DataFrame:
    """The built-in mapping with full names."""
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(CATEGORIES, CATEGORY_NAMES, strict=True))], "class_id int, category string, full_name string")


class _Block(InputPartition):
    def __init__(self, path: str, offset: int, rows: int, first: int):
        self.path, self.offset, self.rows, self.first = path, offset, rows, first


class NpySource(DataSource):
    """``.npy`` matrices, one row of values a record: format("npy").option("path", ...). Files are read by range, in blocks of ``blockRows``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row bigint, values array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blockRows", 65536))

    @staticmethod
    def _header(path: str) -> tuple[tuple, str, int]:
        import numpy as np

        with open(path, "rb") as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
            if fortran or len(shape) != 2:
                raise ValueError(f"{path}: a two-dimensional matrix in row order is needed, not {shape}")
            return shape, dtype.str, f.tell()

    def partitions(self) -> list[_Block]:
        import glob
        import os

        paths = sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]
        out, first = [], 0
        for p in paths:
            (n, _), _, _ = self._header(p)
            out += [_Block(p, i, min(self.block, n - i), first + i) for i in range(0, n, self.block)]
            first += n
        return out or [_Block("", 0, 0, 0)]

    def read(self, part: _Block):
        import numpy as np

        if not part.rows:
            return
        (_, width), dtype, start = self._header(part.path)
        kind = np.dtype(dtype)
        with open(part.path, "rb") as f:
            f.seek(start + part.offset * width * kind.itemsize)
            block = np.fromfile(f, kind, part.rows * width).reshape(part.rows, width).astype(float)
        for i, r in enumerate(block):
            yield part.first + i, r.tolist()


def read_matrix(spark: SparkSession, path: str, block_rows: int = 65536) -> DataFrame:
    """Row, values of a matrix in a folder that every worker sees; the row's number stands in for an id."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("blockRows", str(block_rows)).load()


def read_packed(spark: SparkSession, path: str, dim: int | None = None, block_rows: int = 65536) -> DataFrame:
    """``[dims..., id, class]`` rows as node_id, class_idx, embedding; another width than ``dim`` + 2 is an error."""
    from paperloom.operators.relational import unpack_vector

    df = read_matrix(spark, path, block_rows)
    if dim is not None:
        df = df.withColumn("values", F.when(F.size("values") == dim + 2, F.col("values")).otherwise(F.raise_error(F.format_string("%d values a row, expected %d", F.size("values"), F.lit(dim + 2)))))
    return unpack_vector(df)


def read_ogb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-property data set in the raw layout of the Open Graph Benchmark.

    ``node-feat``, ``node-label`` and ``edge`` are headerless ``.csv.gz``; a node's id is its line's number. A gzip
    file can't be split, so one task reads each. In place of a file there may be a folder of them, whose lines are
    numbered on in the order of the names.
    """

    exists(spark, *[f"{path.rstrip('/')}/{name}.csv.gz" for name in ("node-feat", "node-label", "edge")])

    def lines(name: str) -> DataFrame:
        rows = spark.read.text(f"{path.rstrip('/')}/{name}.csv.gz").select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
        # one row a file; the lines of a file follow one another in a task
        files = rows.groupBy("_file").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
        first = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n") - F.col("_least")).alias("_first"))
        return rows.join(F.broadcast(first), "_file").select((F.col("_id") + F.col("_first")).alias("node_id"), F.split("value", ",").alias("cells"))

    features = lines("node-feat").select("node_id", F.transform("cells", lambda x: x.cast("float")).alias("embedding"))
    labels = lines("node-label").select("node_id", F.get("cells", F.lit(0)).cast("double").cast("int").alias("class_idx"))
    edges = spark.read.text(f"{path.rstrip('/')}/edge.csv.gz").select(F.split("value", ",").alias("cells")).select(F.get("cells", F.lit(0)).cast("long").alias("source"), F.get("cells", F.lit(1)).cast("long").alias("target"))
    return features.join(labels, "node_id", "left").select("node_id", "class_idx", "embedding"), edges


def first_records(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first n rows, by ``order`` if given."""
    return (df.orderBy(order) if order else df).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row concatenation by column names."""
    return reduce(lambda a, b: a.unionByName(b), frames)

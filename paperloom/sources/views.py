"""D1, D4, D6, D14, D15 over the star-schema tables: what the bundled queries run on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

NODES = """select p_partkey as node_id, case when p_partkey % 17 = 0 then null else p_partkey + 2000000000 end as mag_paper_id,
p_name as title, p_type as abstract, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as class_idx from part"""
EDGES = """select source, target from (select l_partkey as source, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as target
from lineitem) x where target is not null"""
EMB = "select vec_id as node_id, label as class_idx, embedding from embeddings"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        return self.spark.sql(NODES.replace("from part", "from {part}"), part=self.table("part"))

    def edges(self) -> DataFrame:
        """A partition has about a million lines, so what a task of the steps after it holds does not grow with the table."""
        lines = self.table("lineitem")
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(lines.count() / 1_000_000))
        return self.spark.sql(EDGES.replace("from lineitem", "from {lineitem}"), lineitem=lines.repartition(parts, "l_orderkey"))

    def emb(self) -> DataFrame:
        return self.spark.sql(EMB.replace("from embeddings", "from {embeddings}"), embeddings=self.table("embeddings"))

    def assignments(self) -> DataFrame:
        """Each vector with its most similar one of the vectors 0 to 9; of equals the smallest."""
        from paperloom.operators.similarity import nearest_centroid

        seeds = self.emb().where("node_id < 10").selectExpr("cast(node_id as int) as cluster_id", "embedding as centroid")
        return nearest_centroid(self.emb(), seeds).select("node_id", "class_idx", "cluster_id")

    def composition(self) -> DataFrame:
        from paperloom.operators.composition import composition

        return composition(self.assignments())

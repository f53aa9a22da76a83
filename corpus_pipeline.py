"""Corpus pipeline: quality, repeated lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns the columns of ``documents``; the last returns packed pieces.
Stages are written as Parquet and read again between steps, and what a stage
leaves in the shared folder is dropped once the next table is written.

All stages take any rows: null ids, texts, languages and sources, empty and
very long texts, repeated rows and empty tables. Extra columns are left behind,
whatever their names; each stage's docstring says what it does with the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.llm.jaccard_join import one_of_each
from paperloom.llm.line_dedup import dedup_lines
from paperloom.llm.packing import pack
from paperloom.llm.quality_gam import held_out, score, train
from paperloom.llm.queries import tokenizer_path
from paperloom.llm.secret_forest import find_secrets, redact
from paperloom.llm.shared import table
from paperloom.session import give_back, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def begin(spark: SparkSession) -> None:
    """Before each stage: the package at the workers, and the memory of the stage before given back, by the driver and the executors.

    Spark's context cleaner drops broadcasts and shuffles when the JVM collects what refers to them, which a
    driver that has room left may not do for a long time. An executor's heap would only grow from stage to stage.
    """
    ship(spark)
    give_back(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null text is scored as an empty one; rows with a null id are scored and never learnt from; each of several
    equal rows gets the same score. Without labels every document stays, and an empty table stays empty.
    """
    begin(spark)
    model = train(docs, table(spark, sf_dir, "labels"), use=~held_out("_id"))
    return score(docs, model).where("score >= 0.7").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left.

    Null and empty texts and documents with a null id stay as they are. Rows of one id with different texts are
    documents of their own; equal rows with the same id end alike. ``n_chars`` is counted anew where lines went.
    """
    begin(spark)
    left = dedup_lines(docs, count="n_gone")
    kept = left.where("n_gone = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null, empty and blank texts and null ids have no duplicates and stay. Rows of one id count as one document,
    which stays or goes with all its rows.
    """
    begin(spark)
    return one_of_each(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays.

    Null text stays null. ``n_chars`` is counted anew where a secret went.
    """
    begin(spark)
    found = find_secrets(docs, path="source")
    clean = found.withColumn("text", redact(F.col("text"), F.col("findings")))
    hit = F.exists("findings", lambda f: f["secret"])
    return clean.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    A null or empty text is its closing id. Each row is packed, equal ones too, and a null id is kept.
    """
    begin(spark)
    return pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        with scratch.passing(spark) as made:
            docs, path = scratch.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(path)
            if before:
                made.append(before)
        before = path
    return docs

"""The pipeline on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def test_stages_run_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*pipeline.COLUMNS)
    counts, before = [docs.count()], {}
    for name, stage in pipeline.STAGES[:-1]:
        before[name] = docs
        docs = stage(spark, docs, DIR).persist()
        assert docs.columns == pipeline.COLUMNS, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    # exact copies lose all their lines, so the near duplicates are looked for among the documents as they were
    assert dict(pipeline.STAGES)["near"](spark, before["lines"], DIR).count() < before["lines"].count()
    pieces = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run(spark):
    assert pipeline.run(spark, DIR).count() > 0


ODD = [(1, "a plain line that stands here\nand a second one, too", "en", "a", 1), (1, "a plain line that stands here\nand a second one, too", "en", "a", 1), (1, "another text of the same id", None, None, None), (None, "a plain line that stands here", "en", "a", 1), (None, None, None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "\n \n", "en", "a", 3), (5, "word " * 200_000, "en", "a", 1), (6, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" " * 50, "en", "a", 1), (7, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" " * 50, "en", "a", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for clash in ("_key", "doc", "maybe", "score", "findings", "_text", "n_gone", "component"):
        docs = docs.withColumn(clash, docs.text)
    rows = stage(spark, docs, str(tmp_path)).collect()
    ids = sorted((r.doc_id or 0) for r in rows)
    if name == "packing":
        whole = [r for r in rows if r.start == 0]
        assert len(whole) == len(ODD) and sorted(r.doc_tokens for r in whole)[:3] == [1, 1, 1]
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in whole)
    else:
        assert list(rows[0].asDict()) == pipeline.COLUMNS
    if name == "lines":
        left = {(r.doc_id, r.text) for r in rows}
        assert {(2, None), (3, ""), (4, "\n \n"), (None, None), (None, "a plain line that stands here")} <= left
        assert ids.count(1) == 3 and 7 not in ids
    if name == "near":
        assert ids == [0, 0, 1, 1, 1, 2, 3, 4, 5, 6]
    if name == "secrets":
        assert len(rows) == len(ODD) and not any("1beb58b8" in (r.text or "") for r in rows)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0


def test_run_leaves_only_its_result(spark, tmp_path):
    import os as files

    from paperloom import scratch

    spark.createDataFrame(ODD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = scratch.folder(spark).removeprefix("file://")
    held = set(files.listdir(folder)) if files.path.isdir(folder) else set()
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and len(set(files.listdir(folder)) - held) == 1


#: On a cluster of two executors, whose logs tell of each collection: a stage's beginning.
ON_A_CLUSTER = """
import time
from pyspark.sql import SparkSession
import corpus_pipeline

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.extraJavaOptions": "-Xlog:gc:file=LOGS/gc-%p.log"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
until = time.time() + 60
while spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() < 3 and time.time() < until:
    time.sleep(0.2)
spark.range(100).count()
corpus_pipeline.begin(spark)
spark.stop()
"""


def test_each_executor_gives_its_memory_back_before_a_stage(tmp_path):
    import pyspark

    home, logs, repo = tmp_path / "home", tmp_path / "logs", Path(pipeline.__file__).resolve().parent
    (home / "work").mkdir(parents=True)  # executors work in Spark's home
    logs.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(k, None)
    ran = subprocess.run([sys.executable, "-c", ON_A_CLUSTER.replace("LOGS", str(logs))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=150)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert [p.read_text().count("Pause Full (System.gc())") for p in logs.iterdir()] == [1, 1]

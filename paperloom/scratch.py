"""Tables written between steps, in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset, a local session
(tests) gets a temporary folder; on a cluster that would be lost with the
machine, so there the setting is required.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def folder(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="paperloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    return f"{base.rstrip('/')}/paperloom-{app}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of this module by its path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str, packed: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as a table and read it back, which cuts its lineage.

    The table outlives lost executors. Returns the frame and the path, for
    ``drop`` once a later table replaces it. ``packed``: blocks of numbers, which
    neither a compression nor a dictionary makes smaller.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "none" if packed else "zstd").option("parquet.enable.dictionary", not packed).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return stage(df, name)[0]


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Drop the tables staged inside when it ends, but for those taken from the list it gives."""
    token = _made.set([])
    try:
        yield (made := _made.get())
    finally:
        _made.reset(token)
    for path in made:
        drop(spark, path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this application has staged."""
    drop(spark, folder(spark))

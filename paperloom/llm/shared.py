"""What several operators of this package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership bitmap; its table has at most 2 ** (FILTER_BITS - 6) rows of 12 bytes (3 MB).
FILTER_BITS = 24


def _slot(key: str, bits: int) -> str:
    return f"({key} & {(1 << bits) - 1}L)"


def key_bitmap(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The set of hashed long keys as a bitmap in words of 64 bits: a table whose size is bounded by ``bits``, whatever the number of keys."""
    slot = _slot(key, bits)
    return keys.where(f"{key} is not null").select(F.expr(f"cast(shiftrightunsigned({slot}, 6) as int) as word"), F.expr(f"shiftleft(1L, cast({slot} & 63L as int)) as bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def fresh(columns: list[str]) -> str:
    """A prefix that none of the columns starts with, for helper columns beside a caller's own."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, bits: int = FILTER_BITS, name: str = "maybe") -> DataFrame:
    """``df`` with the boolean column ``name``: false only if the key surely isn't among those of the bitmap.

    The broadcast side has a proven size bound (see FILTER_BITS), so rows are
    tested where they are read and the rest never enters a shuffle.
    """
    slot, mine = _slot(key, bits), fresh(df.columns)
    word, held = f"{mine}word", f"{mine}bits"
    placed = df.withColumn(word, F.expr(f"cast(shiftrightunsigned({slot}, 6) as int)"))
    joined = placed.join(F.broadcast(bitmap.withColumnsRenamed({"word": word, "bits": held})), word, "left")
    return joined.withColumn(name, F.expr(f"coalesce((shiftrightunsigned({held}, cast({slot} & 63L as int)) & 1L) = 1L, false)")).drop(word, held)


def deal_blocks(df: DataFrame, group: list[str], rows: int, per_task: int) -> DataFrame:
    """Deal the blocks (pairs of chunks ``one`` <= ``two`` of a group) to tasks in turn, each whole, sorted by ``group``, one, two and chunk.

    A large group's blocks go to tasks one after another, so no two meet in
    one while another has none, as they would by a hash. ``rows``: how many
    there are; each task gets about ``per_task``, if there are partitions enough.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-rows // per_task)))
    place = F.xxhash64(*group) + F.expr("cast(two as long) * (two + 1) div 2 + one")
    key = [*group, "one", "two"]
    return df.repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions(*key, "chunk")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of an Arrow batch that holds whole texts or pages, at most.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have Spark send whole texts to Python in batches of at most ``rows``; its default of 10,000 holds ten times the memory, twice in the JVM and twice in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Operator 6: exact duplicates by progressive refinement, in SQL functions only.

Rows are grouped by length, then by a hash of the first bytes, then by a full
hash; each step only takes groups of two or more from the one before. The
surviving keys come back to the scan as a bitmap of bounded size, so only
members of surviving groups (and the bitmap's few false hits) have their
content hashed, and no text enters a shuffle.

Null text counts as empty. Rows are told apart by their id: of rows with equal
text and the same id all have the same ``kept``. A null id never wins over
another one; a group with null ids only has a null ``keep_id`` and keeps its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import ascii_lower, key_bitmap, maybe_in

PREFIX = 64


def normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, **carry: Column) -> DataFrame:
    """doc_id, keep_id (the largest of equal texts), group_size and kept for every row, with the ``carry`` columns, which are computed at the scan."""
    # the text's columns are computed twice from the source, and never moved; lower-casing A-Z changes neither the
    # number of bytes nor where the first characters end, so length and prefix need no lower-cased text
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = df.select(F.col(doc_id).alias("doc_id"), whole.alias("_text"), *[c.alias(n) for n, c in carry.items()])
    keyed = read.withColumns({"_len": F.octet_length("_text"), "_prefix": F.xxhash64(F.octet_length("_text"), ascii_lower(F.substring("_text", 1, prefix)))})
    # by length
    by_length = keyed.select("_len", "_prefix").groupBy("_len", "_prefix").agg(F.count("*").alias("n"))
    lengths = by_length.groupBy("_len").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("_len")
    # by prefix, among those
    prefixes = by_length.where("n > 1").join(lengths, "_len", "left_semi").select("_prefix")
    # by content, among those
    rows = maybe_in(keyed, "_prefix", key_bitmap(prefixes, "_prefix")).withColumn("_full", F.when(F.col("maybe"), F.sha2(ascii_lower(F.col("_text")), 256)))
    groups = rows.where("_full is not null").groupBy("_len", "_full").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    # rows without a full hash get a key of their own, which spreads them and meets no group
    rows = rows.select("doc_id", *carry, "_len", F.coalesce("_full", F.col("doc_id").cast("string"), F.lit("")).alias("_full"))
    # dealt out anew: a join whose both sides are shuffled for it can be split where a large group meets
    joined = rows.join(groups.repartition("_len", "keep"), ["_len", "_full"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), *carry)

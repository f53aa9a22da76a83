"""Relational operators."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.functions.text import clean_latex, text_or_empty


def require_columns(df: DataFrame, names: list[str], warn: bool = False) -> DataFrame:
    """F8: ValueError (or a warning) that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing and warn:
        warnings.warn(f"missing columns: {missing}", stacklevel=2)
    elif missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def resolve_column(df: DataFrame, aliases: list[str], required: bool = False) -> str | None:
    """The first column that bears one of the names, in any case, else one that contains one."""
    low = {c.lower().strip(): c for c in df.columns}
    found = next((low[a.lower()] for a in aliases if a.lower() in low), None) or next((c for a in aliases for k, c in low.items() if a.lower() in k), None)
    if required and not found:
        raise ValueError(f"none of {aliases} in {df.columns}")
    return found


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Nulls become the column's default; a missing column becomes a constant one."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that give null where a value doesn't parse."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """These columns first, all others after them."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def unpack_vector(df: DataFrame, values: str = "values") -> DataFrame:
    """``[dims..., id, class]`` to node_id, class_idx, embedding; ids stay integers (Q1)."""
    return df.select(F.element_at(values, -2).cast("long").alias("node_id"), F.element_at(values, -1).cast("int").alias("class_idx"), F.slice(values, F.lit(1), F.size(values) - 2).cast("array<float>").alias("embedding"))


def pack_vector(df: DataFrame, missing: int = -1) -> DataFrame:
    """node_id, class_idx, embedding to one array of doubles; a missing id is ``missing``."""
    return df.select("node_id", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.coalesce("node_id", F.lit(missing)).cast("double"), F.coalesce("class_idx", F.lit(missing)).cast("double"))).alias("values"))


def paper_id(mag: str | Column = "mag_paper_id", node: str | Column = "node_id") -> Column:
    """``MAG:{id}`` if there is a non-zero id, else ``node_{id}``."""
    m, n = (F.col(x) if isinstance(x, str) else x for x in (mag, node))
    return F.when(m.isNotNull() & (m != 0), F.concat(F.lit("MAG:"), m.cast("string"))).otherwise(F.concat(F.lit("node_"), n.cast("string")))


def map_with_default(df: DataFrame, mapping: DataFrame, key: str, value: str, default: str = "Unknown_") -> DataFrame:
    """Left join with a mapping (key, value); keys that it lacks get ``default`` and the key."""
    return df.join(mapping.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.concat(F.lit(default), F.col(key).cast("string"))))


def unmatched(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """The keys that a mapping lacks."""
    return df.select(key).distinct().join(mapping.select(key), key, "left_anti")


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """0-based positions of the sorted keys. Sorted by range, so no task holds all rows; only the partitions' row counts are summed."""
    parts = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    parts = scratch.staged(parts, "index")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_start")
    # one row for each partition
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1 + F.col("_start")).drop("_p", "_start")


def induced_edges(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Edges with both ends in the set."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    half = edges.join(ids, edges["source"] == ids["_id"], "left_semi")
    return half.join(ids, half["target"] == ids["_id"], "left_semi")


def without(df: DataFrame, other: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows whose key the other frame lacks."""
    return df.join(other.select(key), key, "left_anti")


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """F6."""
    return edges.where("source <> target")


def long_enough(c: str, least: int = 10) -> Column:
    """F9."""
    return F.length(F.trim(F.col(c))) >= least


def is_real_title(c: str = "title") -> Column:
    """not the made-up ``Paper ...``."""
    return ~F.col(c).startswith("Paper")


def null_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row of null counts, with the number of rows."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in names])


def left_join_suffixed(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A left join in which columns of both sides get suffixes."""
    both = (set(left.columns) & set(right.columns)) - {on}
    a, b = (df.withColumnsRenamed({c: c + s for c in both}) for df, s in zip((left, right), suffixes, strict=True))
    return a.join(b, on, "left")


def join_with_fallback(nodes: DataFrame, meta: DataFrame, key: str, prefix: str, columns: dict[str, str]) -> DataFrame:
    """Metadata by the exact key, else by ``prefix`` + key, else the defaults in ``columns``."""
    exact = meta.select(F.col(key).alias("_k1"), *[F.col(c).alias(f"_1{c}") for c in columns])
    other = meta.select(F.col(key).alias("_k2"), *[F.col(c).alias(f"_2{c}") for c in columns])
    joined = nodes.join(exact, F.col(key) == F.col("_k1"), "left").join(other, F.concat(F.lit(prefix), F.col(key)) == F.col("_k2"), "left")
    return joined.select(*nodes.columns, *[F.coalesce(f"_1{c}", f"_2{c}", F.lit(v)).alias(c) for c, v in columns.items()])


def enrich_nodes(nodes: DataFrame, labels: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Class label, paper id, title and abstract of each node, with defaults."""
    out = map_with_default(nodes, labels, "class_idx", "class_label", "unknown_").withColumn("paper_id", paper_id())
    if texts is not None:
        out = out.drop("title", "abstract").join(texts.select(F.col("paper_id").alias("mag_paper_id"), "title", "abstract"), "mag_paper_id", "left")
    return out.withColumns({"title": F.coalesce("title", F.concat(F.lit("Paper "), F.col("node_id").cast("string"))), "abstract": text_or_empty("abstract")})


def edge_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subset's edges with the paper ids of both ends."""
    ids = nodes.select("node_id", paper_id().alias("pid"))
    s, t = (ids.withColumnsRenamed({"node_id": k, "pid": f"{k}_paper_id"}) for k in ("source", "target"))
    return edges.join(s, "source").join(t, "target").select("source", "target", "source_paper_id", "target_paper_id")


def align(nodes: DataFrame, embeddings: DataFrame, order: str | None = None) -> DataFrame:
    """Rows whose id both have, with the vector; ``order`` names the column that gives the order."""
    out = nodes.drop("embedding").join(embeddings.select("node_id", "embedding"), "node_id")
    return out.orderBy(order) if order else out


def bridge_ids(edges: DataFrame, nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Edges in the embeddings' ids: as they are if any end occurs there, else through ``mag_paper_id``; ValueError if that fails too."""
    ids = embeddings.select("node_id").distinct()
    if edges.join(ids, F.col("source") == F.col("node_id"), "left_semi").limit(1).count():
        return edges
    m = nodes.where("mag_paper_id is not null").select("node_id", "mag_paper_id")
    s, t = m.toDF("_s", "source"), m.toDF("_t", "target")
    out = edges.join(s, "source").join(t, "target").select(F.col("_s").alias("source"), F.col("_t").alias("target"))
    if not out.join(ids, F.col("source") == F.col("node_id"), "left_semi").limit(1).count():
        raise ValueError("no id of the edges is in the embeddings, directly or through mag_paper_id")
    return out


def match_titles(left: DataFrame, right: DataFrame, more_than: float = 0.5, per_title: int = 3) -> DataFrame:
    """Pairs (left_id, right_id, overlap) of (id, title) frames whose cleaned titles share more than this share of the left one's words; the ``per_title`` best.

    Overlapping by more than the share takes one of the left title's rarer words
    (all but that share of them, by rarity), so only those are joined on, and
    words that most titles have bring no candidates together. Titles of the same words
    are compared once, and of equal right ones only the ``per_title`` smallest ids can be chosen.
    """
    words = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.array_sort(F.array_distinct(F.filter(F.split(F.lower(clean_latex("title")), r"\s+"), lambda t: t != ""))).alias(f"{n}_words"))
    a, b = words(left, "left"), words(right, "right").distinct()
    place = F.row_number().over(Window.partitionBy("right_words").orderBy("right_id"))
    # per_title ids a set of words
    ids = b.withColumn("_place", place).where(F.col("_place") <= per_title).groupBy("right_words").agg(F.collect_list("right_id").alias("right_ids"))
    b, titles = scratch.staged(ids, "titles"), a.select("left_words").distinct()
    spread = b.select("right_ids", "right_words", F.explode("right_words").alias("word"))
    often = spread.groupBy("word").agg(F.count("*").alias("n"))
    by_rarity = titles.select("left_words", F.explode("left_words").alias("word")).join(often, "word", "left")
    rare = by_rarity.groupBy("left_words").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
    size = F.size("w")
    probe = rare.select("left_words", F.explode(F.slice("w", F.lit(1), (size - F.floor(size * more_than)).cast("int"))).alias("p")).select("left_words", F.col("p.word").alias("word"))
    overlap = F.size(F.array_intersect("left_words", "right_words")) / F.size("left_words")
    shared = probe.join(spread, "word").select("left_words", "right_ids", overlap.alias("overlap")).where(F.col("overlap") > more_than).distinct()
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("overlap"), "right_id"))
    pairs = shared.select("left_words", "overlap", F.explode("right_ids").alias("right_id")).distinct()
    best = pairs.withColumn("rank", rank("left_words")).where(F.col("rank") <= per_title).drop("rank")
    found = a.join(best, "left_words").select("left_id", "right_id", "overlap").distinct()
    return found.withColumn("rank", rank("left_id")).where(F.col("rank") <= per_title).select("left_id", "right_id", "overlap")


def reconstruct_labels(sampled: DataFrame, projected: DataFrame, original: DataFrame, order: str = "node_id") -> DataFrame:
    """The union of two label sets for all of the original rows, in their order."""
    labels = sampled.select("node_id", "cluster_id").unionByName(projected.select("node_id", "cluster_id"))
    return original.join(labels, "node_id", "left").orderBy(order)


def neighbours_of(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes one edge away from the seeds, in either direction, that aren't seeds."""
    ids = seeds.select("node_id")
    out = edges.join(ids, F.col("source") == F.col("node_id"), "left_semi").select(F.col("target").alias("node_id"))
    back = edges.join(ids, F.col("target") == F.col("node_id"), "left_semi").select(F.col("source").alias("node_id"))
    return out.union(back).distinct().join(ids, "node_id", "left_anti").join(nodes.select("node_id"), "node_id", "left_semi")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """G6, D11."""
    return edges.select("source", "target").distinct()


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")



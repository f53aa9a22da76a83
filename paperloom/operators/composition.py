"""Class compositions of clusters and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """The column's sum beside every row. One row is broadcast; a window over everything would put all rows in one task."""
    return df.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))))


def percent(part: str | Column, whole: str | Column) -> Column:
    """100 * part / whole, null for an empty whole."""
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(w > 0, p / w * 100)


def class_distribution(df: DataFrame, column: str = "class_idx") -> DataFrame:
    """Value, count, percentage."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return with_total(counts, "n", "total").select(column, "n", percent("n", "total").alias("percentage"))


def composition(assignments: DataFrame) -> DataFrame:
    """cluster_id, class_id, paper_count, percentage_in_cluster, total_cluster_size, is_dominant_class."""
    counts = assignments.groupBy("cluster_id", F.col("class_idx").alias("class_id")).agg(F.count("*").alias("paper_count"))
    w = Window.partitionBy("cluster_id")
    total = F.sum("paper_count").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("paper_count"), "class_id"))
    return counts.select("cluster_id", "class_id", "paper_count", (F.col("paper_count") / total * 100).alias("percentage_in_cluster"), total.alias("total_cluster_size"), (rank == 1).alias("is_dominant_class"))


def nested_composition(comp: DataFrame) -> DataFrame:
    """One row a cluster, class counts and percentages as maps; a cluster's classes are few."""
    return comp.groupBy("cluster_id").agg(F.sum("paper_count").alias("total_papers"), F.map_from_entries(F.collect_list(F.struct("class_id", "paper_count"))).alias("class_counts"), F.map_from_entries(F.collect_list(F.struct("class_id", "percentage_in_cluster"))).alias("class_percentages"), F.count("*").alias("num_different_classes"), F.max(F.when(F.col("is_dominant_class"), F.col("class_id"))).alias("dominant_class"), F.max("percentage_in_cluster").alias("dominant_class_percentage"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_size_stats(sizes: DataFrame) -> DataFrame:
    """A5: number, largest, smallest, mean and population deviation of cluster sizes."""
    return sizes.agg(F.count("*").alias("n_clusters"), F.max("size").alias("largest"), F.min("size").alias("smallest"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"))


def purity(assignments: DataFrame) -> DataFrame:
    """cluster_id, size, dominant_class (of equals the smallest, never the first seen), purity."""
    return composition(assignments).where("is_dominant_class").select("cluster_id", F.col("total_cluster_size").alias("size"), F.col("class_id").alias("dominant_class"), (F.col("paper_count") / F.col("total_cluster_size")).alias("purity"))


def purity_percent(comp: DataFrame) -> DataFrame:
    """Largest share of each cluster in percent."""
    return comp.groupBy("cluster_id").agg((F.max("paper_count") / F.sum("paper_count") * 100).alias("purity_pct"))


def purity_summary(pure: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest purity, and the mean weighted by size."""
    return pure.agg(F.avg("purity").alias("mean_purity"), F.stddev_pop("purity").alias("std_purity"), F.min("purity").alias("min_purity"), F.max("purity").alias("max_purity"), (F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("weighted_purity"))


def composition_summary(comp: DataFrame) -> DataFrame:
    """A10, A4: numbers of clusters and classes, means, clusters of one and of several classes."""
    each = comp.groupBy("cluster_id").agg(F.count("*").alias("classes"), F.max("percentage_in_cluster").alias("top"))
    return each.agg(F.count("*").alias("total_clusters"), F.avg("classes").alias("avg_classes"), F.avg("top").alias("avg_dominant_pct"), F.count_if(F.col("classes") == 1).alias("single_class"), F.count_if(F.col("classes") > 1).alias("multi_class")).crossJoin(F.broadcast(comp.agg(F.countDistinct("class_id").alias("total_classes"))))


def category_summary(merged: DataFrame, category: str = "category") -> DataFrame:
    """Papers, clusters and share of each category; rows without one are left out."""
    known = merged.where(F.col(category).isNotNull())
    sums = known.groupBy(category).agg(F.sum("paper_count").alias("total_papers"), F.countDistinct("cluster_id").alias("n_clusters"))
    return with_total(sums, "total_papers", "_all").select(category, "total_papers", "n_clusters", percent("total_papers", "_all").alias("percentage"))


def top_categories(merged: DataFrame, n: int = 5, category: str = "category") -> DataFrame:
    """A3, L1, L3: the n largest categories; of equals the first by name."""
    return merged.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum("paper_count").alias("total_papers")).orderBy(F.desc("total_papers"), category).limit(n)


def top_n(comp: DataFrame, n: int = 3) -> DataFrame:
    """The n largest classes of each cluster, with how many are left out."""
    w = Window.partitionBy("cluster_id")
    return comp.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("paper_count"), "class_id")), "more": F.greatest(F.count("*").over(w) - n, F.lit(0))}).where(F.col("rank") <= n)


def top3_wide(comp: DataFrame, names: DataFrame) -> DataFrame:
    """18 columns a cluster: its three largest classes with names, counts and percentages, and the rest. ``names``: class_id, category, full_name."""
    named = top_n(comp, 3).join(F.broadcast(names), "class_id", "left") if names.count() <= 10_000 else top_n(comp, 3).join(names, "class_id", "left")
    named = named.withColumns({"category": F.coalesce("category", F.concat(F.lit("Unknown_"), F.col("class_id").cast("string"))), "full_name": F.coalesce("full_name", "category", F.concat(F.lit("Unknown_"), F.col("class_id").cast("string")))})
    slots = [e for k in (1, 2, 3) for e in (F.coalesce(F.max(F.when(F.col("rank") == k, F.col("category"))), F.lit("None")).alias(f"top{k}_category"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("full_name"))), F.lit("None")).alias(f"top{k}_full_name"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("paper_count"))), F.lit(0).cast("long")).alias(f"top{k}_count"), F.coalesce(F.max(F.when(F.col("rank") == k, F.col("percentage_in_cluster"))), F.lit(0.0)).alias(f"top{k}_percentage"))]
    wide = named.groupBy("cluster_id").agg(F.max("total_cluster_size").alias("total_papers"), *slots)
    three = lambda what: sum((F.col(f"top{k}_{what}") for k in (2, 3)), F.col(f"top1_{what}"))
    wide = wide.withColumns({"top3_total_count": three("count"), "top3_total_percentage": three("percentage")})
    return wide.withColumns({"other_count": F.col("total_papers") - F.col("top3_total_count"), "other_percentage": F.when(F.col("total_papers") > 0, (F.col("total_papers") - F.col("top3_total_count")) / F.col("total_papers") * 100).otherwise(0.0)})


def category_frequency(wide: DataFrame, n: int = 15) -> DataFrame:
    """How often a category is among the top three, the n most frequent."""
    slots = wide.select(F.explode(F.array("top1_category", "top2_category", "top3_category")).alias("category")).where("category <> 'None'")
    return slots.groupBy("category").agg(F.count("*").alias("appearances_in_top3")).orderBy(F.desc("appearances_in_top3"), "category").limit(n)


def confusion_margins(assignments: DataFrame) -> DataFrame:
    """Counts of (class, cluster) with both margins and the total; ``margin`` tells which is summed over (0 none, 1 clusters, 2 classes, 3 both)."""
    return assignments.cube("class_idx", "cluster_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("margin"))


def confusion_block(assignments: DataFrame, size: int = 20) -> DataFrame:
    """Counts among the first ``size`` classes and clusters by number."""
    counts = assignments.groupBy("class_idx", "cluster_id").agg(F.count("*").alias("n"))
    rows, columns = (counts.select(c).distinct().orderBy(c).limit(size) for c in ("class_idx", "cluster_id"))
    return counts.join(F.broadcast(rows), "class_idx", "left_semi").join(F.broadcast(columns), "cluster_id", "left_semi")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the least to the largest value; the last one is closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    placed = df.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return placed.select(F.coalesce("bin", F.lit(0)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def summary_statistics(merged: DataFrame, category: str = "category") -> DataFrame:
    """One row on clusters, classes and purity."""
    each = purity_percent(merged)
    return merged.agg(F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("class_id").alias("n_classes"), F.sum("paper_count").alias("total_papers"), F.count_if(F.col(category).isNull()).alias("unmapped")).crossJoin(F.broadcast(each.agg(F.avg("purity_pct").alias("avg_purity_pct"))))

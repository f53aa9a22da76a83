"""Operator 1: URL filters by a path-template tree.

A URL is its host and the segments of its path. Segments that look variable
(numbers, long hexadecimal strings, UUIDs, dates) become a wildcard of their
shape where the URL is read, which leaves few distinct paths to work on. Then,
from the first segment down to the deepest that two paths of a host share a
node above:

* a node of the tree with more than ``max_branches`` literal children that
  are mostly rare gets one wildcard child in their place;
* sibling branches with the same structure below them are merged into a
  wildcard if the bad share of each, by a two-proportion z test against its
  siblings, is not different from theirs; a branch that differs stays.

A template is rejected if its smoothed bad share, (bad + weight * prior) /
(labelled + weight) with the prior over all labelled URLs, reaches
``reject_share``. All counting is by groups with partial aggregation; only
(host, path) patterns are joined, never gathered.

Null URLs, and those without ``://``, have an empty host and path, fit no
rule and are allowed. Labels that are null count for nothing. Empty tables
give empty results; without labels no template is rejected.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.llm.shared import ascii_lower, fresh

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segment_shapes(path: str, depth: int | None = None) -> Column:
    """The path's segments, variable ones as wildcards; those beyond ``depth``, if given, as one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def shape(s: Column) -> Column:
        stem, tail = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
        kind = F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "{date}").when(stem.rlike(r"^[0-9]+$"), "{n}").when(stem.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}").when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{8,}$"), "{hex}").otherwise(stem)
        return F.concat(kind, tail)

    shapes = F.transform(parts, shape)
    if depth is None:
        return shapes
    return F.when(F.size(parts) > depth, F.concat(F.slice(shapes, 1, depth), F.array(F.lit("{rest}")))).otherwise(shapes)


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits: the longest one that fits host and path; of equal lengths the first in order."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last one that fits wins
        at = text.find("/") if "/" in text else len(text)
        name, start = text[:at].lower(), text[at:]
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def template_tree(paths: DataFrame, max_branches: int = 16, rare: float = 0.02, z: float = 2.58) -> DataFrame:
    """From (host, shape array, n, labelled, bad) the same rows with ``template``, the generalised array."""
    tree, old = scratch.stage(paths.withColumn("template", F.col("shape")), "templates")
    for d in count(1):
        # a node under which there is one path only can't branch, at this level or below
        shared = tree.where(F.size("template") >= d).groupBy("host", F.slice("template", 1, d - 1)).count().where("count > 1")
        if not shared.limit(1).count():
            break
        rest = F.slice(F.col("template"), F.lit(d + 1), F.size("template"))
        here = tree.where(F.size("template") >= d).select("*", F.array_join(F.slice("template", 1, d - 1), "/").alias("prefix"), F.element_at("template", d).alias("seg"), F.xxhash64(rest).alias("suffix"))
        suffixes = here.groupBy("host", "prefix", "seg", "suffix").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        branches = suffixes.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.bit_xor("suffix").alias("below"))
        literal = branches.where("not seg like '{%'")
        nodes = literal.groupBy("host", "prefix").agg(F.count("*").alias("width"), F.sum("n").alias("of_node"))
        alike = literal.groupBy("host", "prefix", "below").agg(F.count("*").alias("siblings"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        judged = literal.join(nodes, ["host", "prefix"]).join(alike, ["host", "prefix", "below"])
        others, other_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = (F.col("all_bad") + 1.0) / (F.col("all_labelled") + 2.0)
        # at least one label on each side to tell two branches apart
        gap = F.when((F.col("labelled") > 0) & (others > 0), F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - other_bad / F.greatest(others, F.lit(1))) / F.sqrt(share * (1 - share) * (1.0 / F.greatest("labelled", F.lit(1)) + 1.0 / F.greatest(others, F.lit(1))))).otherwise(0.0)
        variable = (F.col("width") > max_branches) & (F.col("n") / F.col("of_node") < rare)
        merged = judged.where(variable | ((F.col("siblings") > 1) & (gap < z))).select("host", "prefix", "seg", F.lit("*").alias("to"))
        longer = here.join(merged, ["host", "prefix", "seg"], "left").withColumn("template", F.when(F.col("to").isNotNull(), F.concat(F.slice("template", 1, d - 1), F.array("to"), rest)).otherwise(F.col("template")))
        tree, new = scratch.stage(longer.select(*tree.columns).unionByName(tree.where(F.size("template") < d)), "templates")
        scratch.drop(paths.sparkSession, old)
        old = new
    return tree


def url_filter(pages: DataFrame, labels: DataFrame, url: str = "url", label_key: Column | None = None, rules=RULES, reject_share: float = 0.5, weight: float = 4.0, min_labelled: int = 5, depth: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and bad_share (both null where no template was rejected).

    ``labels`` has ``key`` and ``bad`` (boolean); ``label_key`` gives the key of a page.
    """
    new = ["host", "path", "rule", "verdict", "template", "bad_share"]
    mine = fresh(pages.columns)
    host, path, shape = f"{mine}host", f"{mine}path", f"{mine}shape"
    rows = pages.drop(*[c for c in new if c != url]).withColumns({host: host_of(url), path: path_of(url)}).withColumn(shape, segment_shapes(path, depth))
    keys = rows.select(host, shape, (label_key if label_key is not None else F.lit(None).cast("long")).alias("key"))
    counts = keys.groupBy(F.col(host).alias("host"), F.col(shape).alias("shape")).agg(F.count("*").alias("n"))
    known = keys.where("key is not null").join(labels.select("key", F.col("bad").cast("long").alias("bad")).where("key is not null and bad is not null"), "key").groupBy(F.col(host).alias("host"), F.col(shape).alias("shape")).agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
    paths = counts.join(known, ["host", "shape"], "left").fillna(0, ["labelled", "bad"])
    tree = template_tree(paths)
    total = tree.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("prior"))
    prior = float(total.first()["prior"])
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("bad_share", (F.col("bad") + weight * prior) / (F.col("labelled") + weight))
    rejected = templates.where((F.col("bad_share") >= reject_share) & (F.col("labelled") >= min_labelled))
    blocked = tree.join(rejected.select("host", "template", "bad_share"), ["host", "template"]).select(F.col("host").alias(host), F.col("shape").alias(shape), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "bad_share")
    rule, by_rule = rule_of(host, path, rules)
    judged = rows.join(blocked, [host, shape], "left").withColumns({"rule": rule, "verdict": F.coalesce(by_rule, F.when(F.col("template").isNotNull(), "block").otherwise("allow"))})
    return judged.withColumnsRenamed({host: "host", path: "path"}).drop(shape)


def document_number(url: str = "url") -> Column:
    """The first number that makes up a whole path segment (an extension may follow), as long; null if there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract(regexp_extract({url}, '^[^:]*://[^/?#]*([^?#]*)', 1), '/([0-9]{{1,18}})([.][A-Za-z]+)?(/|$)', 1), '') as bigint)")

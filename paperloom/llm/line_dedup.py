"""Operator 8: near-duplicate lines over the whole corpus by a deletion-neighbourhood join.

Lines are compared lower-cased, trimmed and with single blanks; blank lines are
left alone. A line goes if an equal line comes earlier in the order of (doc_id,
line number), or, where both have ``min_chars`` characters, one within one edit
of it: in a shorter line an edit makes another word.

Equal lines meet by hash. Two different lines within one edit share, after
deleting at most one character of each, a variant: every line emits the hash
of itself and of each of its deletions, with the place of the deletion. A
deletion equal to another line, or equal deletions at the same place, are the
only ways to be one edit apart, so linking each variant's lines to the
earliest of them finds every line that has to go. The few pairs are verified by
the edit distance of their texts.

Only lines that can have such a partner emit variants. Cut in thirds, a line
keeps two of them through an edit, and its length changes by one at most, so
lines that share neither two thirds nor the length with another line are put
aside first. The others are cut into ``BLOCKS`` blocks, and only those that
share all but one block with another line go on, with the deletions in that
block alone. Texts are moved only for the lines and the
documents that a bitmap of bounded size says take part.

The most frequent lines (boilerplate), a list of bounded size, are dropped where
documents are read, so that neither they nor the documents that hold no other
repeated line are moved.

Null text stays null. Documents with a null id are left alone. A document is its
id and its text: rows with the same id and different texts are documents of
their own, in the order of a hash of their texts, and rows with the same id and
text are one and end alike. Lines in a document that repeats itself go as well.
A document may end with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import scratch
from paperloom.llm.shared import fresh, key_bitmap, maybe_in

#: Characters of a line that takes part in the join on one edit, at least.
MIN_CHARS = 16
BLOCKS = 16
#: Hot lines: at most so many, occurring so often at least, of so many characters at most.
HOT, HOT_LEAST, HOT_CHARS = 256, 50, 2000
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(_R, -1, 1 << 64))
_tables = {_R: np.ones(1, np.uint64), int(_INVERSE): np.ones(1, np.uint64)}


def _table(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of a base modulo 2^64, kept and doubled as needed."""
    t = _tables[base]
    while len(t) < n:
        t = np.concatenate([t, t * np.uint64(pow(base, len(t), 1 << 64))])
    _tables[base] = t
    return t[:n]


def _power(n: int) -> np.ndarray:
    return _table(_R, n)


def _inverse_power(at: np.ndarray) -> np.ndarray:
    return _table(int(_INVERSE), int(at.max(initial=0)) + 1)[at]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of a line without any one stretch, from its prefix sums."""

    def __init__(self, line: str):
        c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(c)
        with np.errstate(over="ignore"):
            self.before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(c + np.uint64(1)) * _power(self.n), dtype=np.uint64)])

    def whole(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(self.before[-1:] + _mix(np.full(1, self.n, np.uint64))).view(np.int64)

    def without(self, place: np.ndarray) -> np.ndarray:
        """The hash of the line without the character at each place; equal to ``whole`` of that line."""
        with np.errstate(over="ignore"):
            gone = self.before[place] + (self.before[-1] - self.before[place + 1]) * _INVERSE
            return _mix(gone + _mix(np.full(len(place), self.n - 1, np.uint64))).view(np.int64)

    def around(self, longer: int) -> np.ndarray:
        """For each block of a line ``longer`` characters longer: the hash of what stands before and after it."""
        length = self.n + longer
        cut = length * np.arange(BLOCKS + 1) // BLOCKS
        left, right = cut[:-1], length - cut[1:]
        with np.errstate(over="ignore"):
            tail = (self.before[-1] - self.before[self.n - right]) * _inverse_power(self.n - right)
            key = _mix(self.before[left] + np.uint64(length)) + _mix(tail + np.arange(BLOCKS, dtype=np.uint64))
            return _mix(key).view(np.int64)


def neighbourhood(line: str) -> np.ndarray:
    """Hashes of the line itself and of each of its deletions, in the order of the place deleted."""
    h = Hashes(line)
    return np.concatenate([h.whole(), h.without(np.arange(h.n))])


def document(doc_id: str, text: str) -> Column:
    """What tells documents apart and orders them: the id, and a hash of the text for ids that repeat."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text"))


def lines_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, line_no, line, norm, h1, h2) of each line that isn't blank."""
    whole = F.col(text).cast("string")
    # only runs and odd blanks are replaced, so most texts are merely searched; lower-casing keeps line breaks
    plain = F.regexp_replace(F.lower(whole), r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")
    both = F.arrays_zip(F.split(whole, "\n").alias("line"), F.split(plain, "\n").alias("plain"))
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(document(doc_id, text).alias("doc"), F.posexplode(both).alias("line_no", "l"))
    norm = rows.select("doc", "line_no", F.col("l.line").alias("line"), F.trim("l.plain").alias("norm")).where("norm <> ''")
    return norm.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), "norm")})


def kept_parts(norm: str, min_chars: int) -> Column:
    """Hashes of what one edit can leave of a line, so that two lines within one edit share one; null for a line under ``min_chars``.

    With L the longer one's length, an edit leaves the first two thirds, the
    last two thirds, or the first and the last third. A line may be the longer
    one or one shorter, so there are hashes for L and for L = length + 1.
    """

    def three(length: Column) -> list[Column]:
        g = F.floor(length / 3).cast("int")
        f = (length - g).cast("int")
        left, right = lambda k: F.substring(norm, F.lit(1), k), lambda k: F.right(F.col(norm), k)
        return [F.xxhash64(length, F.lit(0), left(f)), F.xxhash64(length, F.lit(1), right(f)), F.xxhash64(length, F.lit(2), left(g), right(g))]

    n = F.length(norm)
    return F.when(n >= min_chars, F.array(*three(n), *three(n + 1)))


def _rows(batches: Iterator[pa.RecordBatch], make: Callable[[dict], list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that ``make`` gives for each row, beside its h1 and h2."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            made = [make(r) for r in part.to_pylist()]
            at = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
            yield pa.RecordBatch.from_arrays([*part.select(["h1", "h2"]).take(at).columns, *[pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]], names=["h1", "h2", *names])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = np.arange(BLOCKS, dtype=np.int32)

    def make(r: dict) -> list[np.ndarray]:
        h = Hashes(r["norm"])
        return [np.repeat(np.array([0, 1], np.int32), BLOCKS), np.concatenate([block, block]), np.concatenate([h.around(0), h.around(1)])]

    yield from _rows(batches, make, ["longer", "block", "key"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(r: dict) -> list[np.ndarray]:
        h = Hashes(r["norm"])
        spans = [np.arange(h.n * o["block"] // BLOCKS, h.n * (o["block"] + 1) // BLOCKS) for o in r["open"] if not o["longer"]]
        place = np.unique(np.concatenate([*spans, np.zeros(0, np.int64)])).astype(np.int64)
        own = h.whole() if any(o["longer"] for o in r["open"]) else np.zeros(0, np.int64)
        return [np.concatenate([own, h.without(place)]), np.concatenate([np.full(len(own), -1), place]).astype(np.int32)]

    yield from _rows(batches, make, ["variant", "place"])


def near_lines(lines: Callable[[DataFrame], DataFrame], unique: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier one within one edit.

    ``lines`` gives the lines of the documents that a bitmap of hashes names;
    ``unique``: h1, h2, first, parts.
    """
    parts = unique.select("h1", "h2", F.explode("parts").alias("part"))
    shared = parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    alive = maybe_in(parts, "part", key_bitmap(shared, "part")).where("maybe").drop("maybe").join(shared, "part", "left_semi").select("h1", "h2").distinct()
    alive = unique.select("h1", "h2", "first").join(alive, ["h1", "h2"], "left_semi")
    alive, alive_path = scratch.stage(alive, "lines")
    # each distinct line's text from its first place
    found = lines(key_bitmap(alive.select(F.xxhash64("first.doc").alias("key")), "key"))
    found = maybe_in(found, "h1", key_bitmap(alive, "h1")).where("maybe").select("doc", "line_no", "h1", "h2", "norm")
    texts = alive.select("h1", "h2", "first", F.col("first.doc").alias("doc"), F.col("first.line_no").alias("line_no")).join(found, ["doc", "line_no", "h1", "h2"]).select("h1", "h2", "first", "norm").dropDuplicates(["h1", "h2"])
    texts, texts_path = scratch.stage(texts, "texts")
    blocks, blocks_path = scratch.stage(texts.select("h1", "h2", "norm").mapInArrow(_blocks, "h1 bigint, h2 bigint, longer int, block int, key bigint"), "blocks")
    shared = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    going = maybe_in(blocks, "key", key_bitmap(shared, "key")).where("maybe").join(shared, "key", "left_semi")
    opened = going.groupBy("h1", "h2").agg(F.collect_set(F.struct("longer", "block")).alias("open"))  # at most 2 BLOCKS
    made = texts.select("h1", "h2", "norm").join(opened, ["h1", "h2"]).mapInArrow(_variants, "h1 bigint, h2 bigint, variant bigint, place int")
    variants, variants_path = scratch.stage(made.join(texts.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
    scratch.drop(unique.sparkSession, blocks_path)
    own = variants.where("place < 0").select("variant", *[F.col(c).alias(f"e_{c}") for c in ("h1", "h2", "first")])
    deleted = variants.where("place >= 0")
    inserted = deleted.join(own, "variant")
    least = deleted.groupBy("variant", "place").agg(F.min(F.struct("first", "h1", "h2")).alias("e"), F.count("*").alias("n")).where("n > 1").select("variant", "place", F.col("e.h1").alias("e_h1"), F.col("e.h2").alias("e_h2"), F.col("e.first").alias("e_first"))
    replaced = deleted.join(least, ["variant", "place"])
    later = lambda p: p.where("first <> e_first").select(F.when(F.col("first") < F.col("e_first"), F.struct("e_h1", "e_h2", "h1", "h2")).otherwise(F.struct(F.col("h1").alias("e_h1"), F.col("h2").alias("e_h2"), F.col("e_h1").alias("h1"), F.col("e_h2").alias("h2"))).alias("p")).select(F.col("p.e_h1").alias("h1"), F.col("p.e_h2").alias("h2"), F.col("p.h1").alias("e_h1"), F.col("p.h2").alias("e_h2"))
    pairs = later(inserted).unionByName(later(replaced)).distinct()
    a, b = texts.select("h1", "h2", "norm"), texts.select(F.col("h1").alias("e_h1"), F.col("h2").alias("e_h2"), F.col("norm").alias("e_norm"))
    near = pairs.join(a, ["h1", "h2"]).join(b, ["e_h1", "e_h2"]).where(F.levenshtein("norm", "e_norm", 1) >= 0).select("h1", "h2").distinct()
    near, _ = scratch.stage(near, "near")
    for path in (alive_path, texts_path, variants_path):
        scratch.drop(unique.sparkSession, path)
    return near


class Hot:
    """The most frequent repeated lines, at most ``HOT``, as they stand in their first place.

    They are a bounded list of texts, so documents can drop them where they
    are read; only the documents that hold a first place take the other way.
    """

    def __init__(self, decided: DataFrame, df: DataFrame, doc_id: str, text: str):
        top = decided.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "h1", "h2").limit(HOT).select(F.col("first.doc").alias("doc"), F.col("first.line_no").alias("no"))
        # at most HOT rows are broadcast, and as many lines come to the driver
        places = df.select(document(doc_id, text).alias("doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(top), "doc").select(F.xxhash64("doc").alias("key"), F.get(F.split("text", "\n"), F.col("no")).alias("line"))
        rows = places.where(F.length("line") <= HOT_CHARS).distinct().select("*", F.xxhash64("line").alias("raw")).collect()
        self.lines, self.raw = [r["line"] for r in rows], [r["raw"] for r in rows]
        self.first = [r["key"] for r in rows]

    def drops(self, key: Column, line: Column) -> Column:
        """Whether a line of the document with this hash is a hot one and surely not its first."""
        return line.isin(self.lines) & ~key.isin(self.first) if self.lines else F.lit(False)


def decide(df: DataFrame, doc_id: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame, Hot]:
    """(marked, decided, hot): all lines (doc, line_no, h1, h2), the repeated ones (h1, h2, first, near, n), and the hot ones."""
    marked = lines_of(df, doc_id, text).withColumn("parts", kept_parts("norm", min_chars))
    marked, _ = scratch.stage(marked.select("doc", "line_no", "h1", "h2", F.xxhash64("line").alias("raw"), "parts"), "marked")
    unique = marked.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("n"), F.first("parts").alias("parts"))
    unique, unique_path = scratch.stage(unique, "unique")

    def of_documents(bitmap: DataFrame) -> DataFrame:
        asked = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
        asked = maybe_in(asked.withColumn("key", F.xxhash64(document("id", "text"))), "key", bitmap)
        return lines_of(asked.where("maybe"), "id", "text")

    near = near_lines(of_documents, unique).withColumn("near", F.lit(True))
    decided = unique.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "n")
    decided, _ = scratch.stage(decided, "decided")
    scratch.drop(df.sparkSession, unique_path)
    return marked.drop("parts"), decided, Hot(decided, df, doc_id, text)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, count: str | None = None) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``; ``count``, if named, gets the number of lines that went."""
    marked, decided, hot = decide(df, doc_id, text, min_chars)
    easy = F.col("raw").isin(hot.raw) & ~F.xxhash64("doc").isin(hot.first) if hot.raw else F.lit(False)
    placed = maybe_in(marked.where(~easy), "h1", key_bitmap(decided, "h1")).where("maybe").drop("maybe").join(decided, ["h1", "h2"]).where(F.col("near") | (F.struct("doc", "line_no") != F.col("first")))
    gone, _ = scratch.stage(placed.groupBy("doc").agg(F.collect_set("line_no").alias("gone")), "gone")
    mine = fresh(df.columns)
    key, cold, warm, of_id, of_text, lost, parts, left, n = (mine + x for x in ("key", "cold", "hot", "id", "text", "lost", "parts", "lines", "n"))
    keys = lambda d: d.select(F.xxhash64("doc").alias(key))
    # documents without a repeated line are not touched, and those with hot ones alone are not moved
    asked = df.withColumn(key, F.xxhash64(document(doc_id, text)))
    for name, some in ((cold, keys(gone)), (warm, keys(marked.where(easy)))):
        asked = maybe_in(asked, key, key_bitmap(some, key), name=name)
    lines = F.col(parts)  # split once: by place, each line is looked up in it
    asked = asked.withColumn(parts, F.split(F.col(text).cast("string"), "\n"))
    named = gone.select(F.col("doc.id").alias(of_id), F.col("doc.text").alias(of_text), F.col("gone").alias(lost))
    moved = asked.where(F.col(cold)).drop(parts).join(named, (F.col(doc_id) == F.col(of_id)) & (document(doc_id, text)["text"] == F.col(of_text)), "left").drop(of_id, of_text)
    moved = moved.withColumn(parts, F.split(F.col(text).cast("string"), "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(lost, F.array().cast("array<int>")))
    by_place = F.transform(rest, lambda i: F.get(lines, i))
    stays = lambda x: ~hot.drops(F.col(key), x)
    # in one expression: what is left by place, then without the hot lines
    unmoved = asked.where(~F.col(cold)).withColumn(left, F.when(F.col(warm) & F.col(doc_id).isNotNull() & F.col(text).isNotNull(), F.filter(lines, stays)))
    moved = moved.withColumn(left, F.when((F.col(lost).isNotNull() | F.col(warm) & F.col(doc_id).isNotNull()) & F.col(text).isNotNull(), F.filter(by_place, stays))).drop(lost)
    both = unmoved.unionByName(moved)
    both = both.withColumn(n, F.when(F.col(left).isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("int"))
    both = both.withColumn(text, F.when(F.col(n) > 0, F.array_join(left, "\n")).otherwise(F.col(text)))
    return (both.withColumn(count, F.col(n)) if count else both).drop(key, cold, warm, parts, left, n)

"""Operators 2, 6, 8 and 9 against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard_join, line_dedup
from paperloom.llm.embedding_dedup import near_vectors
from paperloom.llm.exact_dedup import exact_dedup, normalised
from paperloom.llm.jaccard_join import least_matches, one_of_each, similar_documents
from paperloom.llm.line_dedup import dedup_lines, neighbourhood
from paperloom.llm.shared import key_bitmap, maybe_in


def groups_of(links):
    out = {}
    for i in sorted(links):
        if i in out:
            continue
        todo = [i]
        while todo:
            a = todo.pop()
            if a not in out:
                out[a] = i
                todo += links[a]
    return out


def test_bitmap_has_no_false_negatives(spark):
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("k"))
    asked = maybe_in(spark.range(3000).select("id", F.xxhash64("id").alias("k")), "k", key_bitmap(keys, "k"))
    yes = {r.id for r in asked.where("maybe").collect()}
    assert set(range(0, 3000, 7)) <= yes and len(yes) < 600


def test_exact(spark):
    long = "É" * 50_000
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, long), (7, long), (8, "É"), (9, "é"), (None, "Same"), (10, "x" * 70 + "a"), (11, "x" * 70 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "_len": F.lit(2), "maybe": F.lit(3)})
    got = {r.doc_id: r for r in exact_dedup(df, text_sha256=F.sha2(normalised("text"), 256)).collect()}
    assert len(got) == len(rows)
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items() if r.group_size > 1} == {1: (2, 3, False), 2: (2, 3, True), None: (2, 3, False), 4: (5, 2, False), 5: (5, 2, True), 6: (7, 2, False), 7: (7, 2, True)}
    assert got[2].text_sha256 == hashlib.sha256(b"same").hexdigest()
    assert all(r.kept and r.keep_id == k for k, r in got.items() if r.group_size == 1)
    assert exact_dedup(df.limit(0)).count() == 0


def near_copies(rng, base, n, change):
    for _ in range(n):
        words = base.split()
        for _ in range(change):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        yield " ".join(words)


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    for g in range(8):
        base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(300)) for _ in range(120))
        for t in [base, base, *near_copies(rng, base, 6, 1), *near_copies(rng, base, 4, 3), *near_copies(rng, base, 2, 12)]:
            texts[len(texts)] = t
    big = " ".join(f"big{i}" for i in range(400))
    for t in near_copies(rng, big, 60, 2):  # more than one chunk of 16
        texts[len(texts)] = t
    extra = {900: None, 901: "", 902: "one two", 903: "One  TWO", 904: "   ", 905: "w " * 30_000}
    texts |= extra

    def grams(t):
        w = (t or "").lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    links = defaultdict(set, {i: set() for i in texts})
    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    comp = groups_of(links)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"rep": F.lit(0), "component": F.lit("c"), "size": F.lit(1)}).repartition(3)
    got = {r.doc_id: r for r in similar_documents(df, block=16).collect()}
    assert {i: (got[i].component_id, got[i].n_links, got[i].kept) for i in texts} == {i: (comp[i], len(links[i]), comp[i] == i) for i in texts}
    assert {r.doc_id for r in one_of_each(df).collect()} == {i for i in texts if comp[i] == i}
    assert one_of_each(df).columns == df.columns


def test_jaccard_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = similar_documents(df).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 1
    assert similar_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similar_documents(df, threshold=0.2)


def test_pruning_bound_falls_with_tolerance():
    assert least_matches(24, 0.8, 1e-2) > least_matches(24, 0.8, 1e-6) > 0
    assert least_matches(120, 0.8, 1e-6) < 96


def test_bands_miss_no_more_than_pruning():
    assert (1 - 0.8**jaccard_join.ROWS) ** jaccard_join.BANDS <= 1e-6
    sig = jaccard_join.minhash(jaccard_join.grams("one two three four five six seven"))
    assert len(set(jaccard_join.bands(sig).tolist())) == jaccard_join.BANDS


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_neighbourhood_hashes_equal_strings():
    full = lambda s: int(neighbourhood(s)[0])
    for s in ("abcde", "aab", "é😀x"):
        assert [int(h) for h in neighbourhood(s)[1:]] == [full(s[:i] + s[i + 1 :]) for i in range(len(s))]


@pytest.mark.parametrize("hot", [(256, 50), (3, 2)])
def test_lines_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot[0])
    monkeypatch.setattr(line_dedup, "HOT_LEAST", hot[1])
    rng = random.Random(4)
    pool = ["".join(rng.choice("abc defgh") for _ in range(rng.randrange(10, 70))).strip() for _ in range(40)]
    docs = {}
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            x = rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(50))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(x))
                x = rng.choice([x[:at] + x[at + 1 :], x[:at] + "z" + x[at:], x[:at] + "q" + x[at + 1 :]])
            lines.append(x.upper() if rng.random() < 0.1 else x)
        docs[d] = "\n".join(lines)
    docs |= {100: None, 101: "", 102: "\n\n", 103: "a" * 5000, 104: "a" * 4999, 105: "tab\tand   blanks in here", 106: "Tab and blanks in here", 107: "short\n\nshorT\n}", 108: " short \nshore\n}\n}\n ", 109: "fifteen chars ab\nfifteen chars a", 110: "fifteen chars a\nfifteen chars b"}
    norm = lambda x: " ".join(x.lower().split())
    earlier, expect = [], {}
    for d in sorted(docs):
        if docs[d] is None:
            expect[d] = None
            continue
        kept = []
        for x in docs[d].split("\n"):
            n = norm(x)
            if not n or n not in earlier and (len(n) < 16 or not any(len(e) >= 16 and edit_within_one(n, e) for e in earlier)):
                kept.append(x)
            earlier.append(n)
        expect[d] = "\n".join(kept)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"gone": F.lit(1), "maybe": F.lit(2), "norm": F.lit("x")}).repartition(3)
    rows = dedup_lines(df, count="n_removed").collect()
    assert {r.doc_id: r.text for r in rows} == expect
    assert {"gone", "norm"} <= set(dedup_lines(df.drop("maybe")).columns)


def test_lines_of_repeated_ids(spark):
    """Rows with the same id and different texts are documents of their own; no line goes that nothing repeats."""
    df = spark.createDataFrame([(1, "a shared long line of text here\nfoo bar"), (5, "a shared long line of text here\nsecond"), (5, "a wholly different first line for five\nthird"), (5, "a wholly different first line for five\nthird")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(df).collect()) == sorted(["a shared long line of text here\nfoo bar", "second"] + ["a wholly different first line for five\nthird"] * 2)


def test_hot_lines_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 2)
    hot = "the same long line again and again"
    df = spark.createDataFrame([(3, hot), (3, "tiny"), (92, hot + "\ntiny bit"), *[(100 + i, hot) for i in range(70)]], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in dedup_lines(df).collect())
    assert got[:3] == [(3, hot), (3, "tiny"), (92, "tiny bit")] and {t for _, t in got[3:]} == {""}


def test_lines_keep_clashing_columns(spark):
    names = ["_n", "_lines", "_cold", "_hot", "_key", "_word", "_bits", "__key", "maybe", "doc", "h1", "first"]
    df = spark.createDataFrame([(i, "one long line that repeats\nword") for i in range(3)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    rows = dedup_lines(df).collect()
    assert [c for c in rows[0].asDict()] == df.columns and all(r[c] == c for r in rows for c in names)
    assert sorted(r.text for r in rows) == ["", "", "one long line that repeats\nword"]


def test_lines_odd_ids(spark):
    df = spark.createDataFrame([(None, "this is a long line here"), (None, "this is a long line here"), (3, "this is a long line here"), (3, "this is a long line here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in dedup_lines(df).collect()) == [(0, "this is a long line here")] * 2 + [(3, "this is a long line here")] * 2
    assert dedup_lines(df.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, label = [], {}
    for g in range(40):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.3])).tolist(), int(g % 4)))
    hot = rng.standard_normal(32)
    rows += [(1000 + i, (hot + rng.standard_normal(32) * 0.05).tolist(), 7) for i in range(80)]
    rows += [(3000 + i, rows[-1][1], 7) for i in range(50)]  # copies
    odd = [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [None] + [1.0] * 31, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] * 32, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(1)).repartition(3)
    x = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    label = {r[0]: r[2] for r in rows}
    links = defaultdict(set, {r[0]: set() for r in rows + odd})
    for i in x:
        for j in x:
            if i < j and label[i] == label[j] and x[i] @ x[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    links[2006].add(2007)
    links[2007].add(2006)
    got = {r.vec_id: r for r in near_vectors(df, block=32).collect()}
    assert set(got) == set(links)
    found, there = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert there * 0.97 <= found <= there
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert all(got[i].n_links == 0 for i, *_ in odd if i not in (2006, 2007))
    assert all(got[i].kept == (got[i].component_id == i) for i in links)
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_lose_no_pair_at_the_threshold(spark):
    """Pairs at just 0.93, each in two directions of its own, are all linked, whatever the number of other rows."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(1500):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [(2 * g, a.tolist(), 0), (2 * g + 1, (0.9301 * a + np.sqrt(1 - 0.9301**2) * b).tolist(), 0)]
    x = np.array([r[1] for r in rows])
    links = np.argwhere(np.triu(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= 0.93, 1))
    assert len(links) == 1500
    for part in (rows, rows[:40]):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(part, "vec_id long, embedding array<double>, label int")).collect()}
        assert got == {r[0]: (1, r[0] // 2 * 2, r[0] % 2 == 0) for r in part}

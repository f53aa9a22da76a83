"""Operators 3 and 5 against the tokenizers library and by exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.bpe import LONG, Codec, bpe_decode, bpe_encode, check_supported
from paperloom.llm.packing import RoomTree, best_fit_decreasing, pack, plan

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, long=24, leaf=6)  # small, so that trees are built all the time


CASES = ["", "a", "the cat's 'ssssssssssssssssssssssssssssss", "x" * 500, "  " * 60 + "end", " \n" * 80, "!" * 200 + "word", "1234567890" * 30, "<|endoftext|>" * 3 + "a" * 100, "né" * 200, "\x1c" * 70, "don't" * 40, "日本語" * 60, "a" * 30 + " " * 30 + "b" * 30 + "\u0085" * 40 + "'re", "ab" * 40 + "'" * 40 + "s" * 40]


@pytest.mark.parametrize("text", CASES)
def test_tree_equals_library(codec, reference, text):
    assert codec.encode(text) == reference(text)
    assert codec.decode(codec.encode(text)) == text


@pytest.fixture(scope="module")
def small():
    return Codec(PATH, long=16, leaf=4)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab' sré1!?\n\t<|endoftext|>\u00a0"), max_size=200), st.integers(1, 60))
def test_tree_equals_library_at_random(small, reference, text, repeat):
    long = text + text[:3] * repeat
    assert small.encode(long) == reference(long)


def test_very_long_text(reference):
    text = "abcdefgh" * 20_000 + " tail"
    assert Codec(PATH).encode(text) == reference(text)


@pytest.fixture(scope="module")
def usual():
    return Codec(PATH)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["hello", "\n", "\n\n", "\n\n\n", "\u00a0\u00a0", " ", "  ", "\t\t", "'s", "<|endoftext|>", "7", "!", "\r\n"]), max_size=5), st.sampled_from(["x", "ab", "日本", "é", "7", "=", "-+", "'", " ", "\n", "\u00a0", "\n "]), st.integers(0, 900), st.lists(st.sampled_from(["\n\n", "  ", "word", "'t", "!", "9", "\u00a0\u00a0x"]), max_size=4))
def test_long_runs_after_blanks_equal_library(usual, reference, before, unit, more, after):
    text = "".join(before) + unit * (-(-LONG // len(unit)) + more) + "".join(after)
    ids = usual.encode(text)
    assert ids == reference(text)
    assert usual.decode(ids) == text


def test_unsupported_files_raise():
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    check_supported(file)
    for part, key, value in (("model", "ignore_merges", True), ("model", "dropout", 0.1), ("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Metaspace"), (None, "normalizer", {"type": "NFC"}), (None, "added_tokens", [{"lstrip": True}])):
        changed = {**file, part: {**file[part], key: value}} if part else {**file, key: value}
        with pytest.raises(ValueError, match=key if part != "pre_tokenizer" else part):
            check_supported(changed)


def test_encode_frame_and_back(spark, reference):
    df = spark.createDataFrame([(1, "one two", "kept"), (1, "one two", "kept"), (2, None, None), (None, "", "x")], "doc_id long, text string, decoded string")
    rows = bpe_encode(df, PATH, decoded="decoded").collect()
    assert sorted((r.doc_id or 0, r.text or "", list(r.ids), r.decoded) for r in rows) == [(0, "", [], ""), (1, "one two", reference("one two"), "one two"), (1, "one two", reference("one two"), "one two"), (2, "", [], "")]
    back = bpe_decode(bpe_encode(df, PATH, keep=["doc_id"]), PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "one two", "one two"]
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_room_tree():
    t = RoomTree(8)
    for r in (3, 5, 5):
        t.add(r, 1)
    assert [t.least(k) for k in (1, 3, 4, 5, 6)] == [3, 3, 5, 5, -1]
    t.add(5, -1)
    t.add(5, -1)
    assert t.least(4) == -1


def test_best_fit_is_tightest():
    windows = best_fit_decreasing([7, 5, 3, 2, 2], 8)
    assert [sorted([7, 5, 3, 2, 2][i] for i in w) for w in windows] == [[7], [3, 5], [2, 2]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_equals_brute_force(lengths):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - n)
    windows = best_fit_decreasing(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[i] for i in w) for w in windows) == sorted(rooms)


def test_plan_keeps_tight_windows_and_pads_little():
    rng = np.random.default_rng(4)
    for _ in range(100):
        lengths = rng.integers(1, 3000, rng.integers(1, 200)).tolist()
        sequences = plan(lengths, 2048)
        used = [sum(p[2] for p in s) for s in sequences]
        assert all(2048 - u <= 8 or u & (u - 1) == 0 for u in used)
        whole = {d for s in sequences for d, at, n in s if n == lengths[d] % 2048}
        rest = [n % 2048 for n in lengths]
        tight = [w for w in best_fit_decreasing([r for r in rest if r], 2048) if 2048 - sum([r for r in rest if r][i] for i in w) <= 8]
        assert len(whole) >= sum(map(len, tight))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_plan_holds_every_token_once(lengths):
    seen = [np.zeros(n, int) for n in lengths]
    for seq in plan(lengths, 64):
        assert 0 < sum(p[2] for p in seq) <= 64
        for d, at, n in seq:
            assert n > 0
            seen[d][at : at + n] += 1
    assert all((s == 1).all() for s in seen)
    used = [sum(p[2] for p in s) for s in plan(lengths, 64)]
    assert sum(64 - u for u in used if u & (u - 1)) <= 8 * len(used)


def test_pack_frame(spark, reference):
    texts = {1: "word " * 3000, 2: None, 3: "", 4: "short one", 5: "x" * 9000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("offset", __import__("pyspark").sql.functions.lit(9)).repartition(2)
    rows = pack(df, PATH).collect()
    for d, t in texts.items():
        ids, at = [*reference(t or ""), 1], 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            assert zlib.crc32(bytes(r.ids)) >= 0
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(df.limit(0), PATH).count() == 0


def test_pack_takes_any_id_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", "one two three"), ("a", "one two three"), (None, "four"), ("b", None)], "doc_id string, text string")
    for kind in ("string", "int", "binary", "decimal(9,2)"):
        found = pack(df.withColumn("doc_id", df.doc_id.cast("binary") if kind == "binary" else df.doc_id if kind == "string" else __import__("pyspark").sql.functions.ascii("doc_id").cast(kind)), PATH)
        assert dict(found.dtypes)["doc_id"] == kind
        rows = found.collect()
        assert sum(r.doc_id is None for r in rows) == 1 and len({r.doc_id for r in rows}) == 3
        assert sorted(r.doc_tokens for r in rows if r.start == 0) == [1, 2, 4, 4]

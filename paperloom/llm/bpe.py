"""Operator 3: byte-level BPE encoding and decoding by tree concatenation.

Ordinary text is encoded directly: its pre-tokens are short. A text with a
pre-token that may be long is split into pre-tokens as a whole, since where one
ends depends on what follows it. A pre-token longer than ``LONG`` characters (text without a split) is halved until its
leaves are short, the leaves are encoded in parallel threads, and the results
are joined up the tree. At each join the last and first few tokens are encoded
again in a window that doubles until its first token equals the left side's
and its last token equals the right side's. Every neighbouring pair of tokens
then occurs in a valid encoding, which for BPE makes the whole one valid, so
the result is that of encoding the text at once.

Null text counts as empty and has no tokens. Every row is its own result, so
ties, repeated rows and extra columns need nothing special.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.shared import text_batches

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of one class of characters from this length on is encoded as a tree.
LONG = 2048
#: Bytes of a leaf, at most.
LEAF = 512
THREADS = 4


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_supported(file: dict) -> None:
    """Raise for a tokenizer file with settings that this codec would encode differently."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "") for m in model.get("merges", [])]
    ranks = [model["vocab"].get(m, -1) for m in merged]
    wrong = [
        name
        for name, bad in {
            "model.type": model.get("type") not in (None, "BPE"),
            "model.dropout": model.get("dropout"),
            "model.byte_fallback": model.get("byte_fallback"),
            "model.ignore_merges": model.get("ignore_merges"),
            "model.continuing_subword_prefix": model.get("continuing_subword_prefix"),
            "model.end_of_word_suffix": model.get("end_of_word_suffix"),
            "model.merges (ids must follow the order of the merges)": ranks != sorted(ranks) or -1 in ranks,
            "normalizer": file.get("normalizer"),
            "pre_tokenizer": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
            "added_tokens": any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"tokenizer settings that aren't supported: {', '.join(wrong)}")


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check_supported(file)
        byte_of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab = {k: v for k, v in file["model"]["vocab"].items() if k not in self.special}
        self.token = {v: bytes(byte_of[c] for c in k) for k, v in vocab.items()}
        self.core = tiktoken.Encoding("codec", pat_str=PATTERN, mergeable_ranks={b: v for v, b in self.token.items()}, special_tokens=self.special)
        self.whole = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        blank = r"\p{White_Space}"  # Python's \s also takes the separators 1C to 1F
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", f"[^{blank}").replace(r"\s", blank).replace(r"\S", r"\P{White_Space}"))
        self.long, self.leaf = long, leaf
        self.runs = regex.compile(rf"\p{{L}}{{{long},}}|\p{{N}}{{{long},}}|[^{blank}\p{{L}}\p{{N}}]{{{long},}}|{blank}{{{long},}}")
        self.pool = None

    def bpe(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of a pre-token from those of the parts."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.bpe(b"".join(self.token[x] for x in (*a, *b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return [*left[:-k], *window, *right[k:]]
            k *= 2

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of one pre-token by halving, leaves in parallel, and joins."""
        count = 1
        while len(piece) / count > self.leaf:
            count *= 2
        cuts = [len(piece) * i // count for i in range(count + 1)]
        self.pool = self.pool or ThreadPoolExecutor(THREADS)
        parts = list(self.pool.map(self.bpe, (piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False))))
        while len(parts) > 1:
            parts = list(self.pool.map(self.join, parts[::2], parts[1::2]))
        return parts[0]

    def may_run(self, text: str) -> bool:
        """Whether a long run is possible: a cheap test by word lengths, as direct encoding is right in any case."""
        if len(text) < self.long:
            return False
        lengths = list(map(len, text.split()))
        return max(lengths, default=0) >= self.long or len(text) - sum(lengths) - len(lengths) >= self.long - 1

    def encode(self, text: str) -> list[int]:
        """As the tokenizers library: strings of special tokens in the text become their ids."""
        if not self.may_run(text) or not self.runs.search(text):
            return self.core.encode(text, allowed_special="all")
        out: list[int] = []
        for part in regex.split(f"({self.whole})", text) if self.whole else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            # the split of the whole part: where a pre-token ends depends on what follows it
            for m in self.pattern.finditer(part):
                piece = m[0].encode()
                out += self.tree(piece) if len(m[0]) >= self.long else self.bpe(piece)
        return out

    def decode(self, ids) -> str:
        """All tokens' bytes, special ones included; bytes that aren't UTF-8 become replacement characters."""
        return self.core.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def bpe_encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and, if named, ``decoded``: the text that the ids stand for.

    ``keep`` names the columns to return besides (all if None); a column with
    the name of a new one is replaced. No shuffle: each row is encoded where it is read.
    """
    new = [ids, *([decoded] if decoded else [])]
    rest = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                texts = pc.fill_null(b.column(text).cast(pa.string()), "").to_pylist()
                found = [c.encode(t) for t in texts]
                columns = {n: b.column(n) for n in rest} | {ids: pa.array(found, pa.list_(pa.int32()))}
                if decoded:
                    columns[decoded] = pa.array([c.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    text_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*rest, text])).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add ``text`` from an array of ids; null ids give an empty text."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(text, T.StringType(), False)])

    def run(batches):
        c = codec(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in rest} | {text: pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())})

    return df.select(*rest).mapInArrow(run, schema)

"""Operator 5: packing token sequences by best-fit decreasing.

Every scan partition packs its own documents, in batches of at most
``BATCH_TOKENS`` tokens, so memory is bounded and nothing is shuffled; a task
that runs again packs the same rows the same way. In a batch, documents are
first cut into full windows; what remains of each is placed, longest first,
into the open window with the least room that still fits it. A segment tree
over room (0 to the window's size) finds that room. Windows that end with at
most ``slack`` tokens of room stay as they are. The others keep their pieces and
are filled up, fullest first: the emptiest window is taken apart, the longest of
its pieces that fits goes in whole, and where none fits the shortest is cut. What
is left of the last window is cut at powers of two, which need no padding.

A document is its ids and the closing id, so a null or empty text is one
token. Ids may be of any type; a null one is kept. Repeated rows are packed
once for each row.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.bpe import codec
from paperloom.llm.shared import text_batches

BATCH_TOKENS = 4_000_000
#: Room that a window may keep as padding.
SLACK = 8


class RoomTree:
    """Which rooms have open windows: a binary tree of counts over 0 .. size."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The smallest room >= need that is there, or -1."""
        i = need + self.base
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of item numbers; items are no longer than ``size``. Ties go to the item that comes first and the window opened last."""
    tree, open_at, windows = RoomTree(size), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        room = tree.least(need)
        if room < 0:
            room, w = size, len(windows)
            windows.append([])
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        windows[w].append(item)
        if room > need:
            open_at.setdefault(room - need, []).append(w)
            tree.add(room - need, 1)
    return windows


def plan(lengths: list[int], size: int, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of each document once."""
    done, rest = [], []
    for d, n in enumerate(lengths):
        done += [[(d, at, size)] for at in range(0, n - size + 1, size)]
        if n % size:
            rest.append((d, n - n % size, n % size))
    used = lambda w: sum(p[2] for p in w)
    packed = sorted(([rest[i] for i in w] for w in best_fit_decreasing([r[2] for r in rest], size)), key=used, reverse=True)
    pool: list[tuple[int, int, int]] = []  # (length, document, start) of the pieces of windows taken apart, by length
    lo, hi = 0, len(packed)
    while lo < hi:
        room = size - used(packed[lo])
        if room <= slack:
            done.append(packed[lo])
            lo += 1
            continue
        while room:
            if not pool:
                if lo + 1 == hi:
                    break
                hi -= 1
                pool = sorted((n, d, at) for d, at, n in packed[hi])
            fits = bisect_right(pool, (room, len(lengths), 0))
            n, d, at = pool.pop(max(0, fits - 1))
            take = min(n, room)  # the longest piece that fits, or a cut of the shortest
            packed[lo].append((d, at, take))
            if take < n:
                insort(pool, (n - take, d, at + take))
            room -= take
        if room and room > slack:
            pool = sorted((n, d, at) for d, at, n in packed[lo])
        else:
            done.append(packed[lo])
        lo += 1
    left = sum(p[0] for p in pool)
    while left:  # less than a window is left
        part = left if size - left <= slack else 1 << (left.bit_length() - 1)
        left -= part
        seq = []
        while part:
            n, d, at = pool.pop()
            take = min(part, n)
            seq.append((d, at, take))
            if take < n:
                pool.append((n - take, d, at + take))
            part -= take
        done.append(seq)
    return done


def pack(df: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids: its ids as little-endian unsigned 32-bit numbers.

    ``sequence_id`` is unique over all partitions: the partition's number in the upper bits.
    """
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *[T.StructField(n, T.LongType(), False) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType(), False)])

    def flush(names: list[pa.Array], docs: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(names)
        rows: list[tuple] = []
        for k, seq in enumerate(plan([len(x) for x in docs], size)):
            offset = 0
            for d, at, n in seq:
                rows.append((d, at, n, len(docs[d]), base + k, offset, docs[d][at : at + n].tobytes()))
                offset += n
        for i in range(0, len(rows), 4096):
            part = list(zip(*rows[i : i + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(part[0])), *[pa.array(c, pa.int64()) for c in part[1:6]], pa.array(part[6], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = codec(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        names, docs, total = [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                names.append(part.column(0))
                for t in pc.fill_null(part.column(1).cast(pa.string()), "").to_pylist():
                    docs.append(np.array([*c.encode(t), end_id], dtype="<u4"))
                    total += len(docs[-1])
                if total >= batch_tokens:
                    yield from flush(names, docs, base)
                    base += total  # more than the sequences that were made
                    names, docs, total = [], [], 0
        if docs:
            yield from flush(names, docs, base)

    text_batches(df.sparkSession)
    return df.select(doc_id, text).mapInArrow(run, schema)

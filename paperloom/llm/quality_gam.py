"""Operator 4: a generalised additive model with pairwise interactions for text quality.

Each feature of a text is cut into at most ``bins`` bins at quantiles of the
training rows. Cyclic boosting fits one shallow tree at a time, feature after
feature, round after round, to the logistic loss; trees of one feature add up
to its lookup table. The pairs of features that explain most of what is left
then get tables of two dimensions in the same way. A score is the logistic
function of a sum of looked-up values, added for whole batches at once.

The model is fitted on at most ``SAMPLE`` labelled rows (those with the
smallest hash of the id), a documented bound; every row is scored by its whole
text. Null text counts as empty and gets a score like any other. Null labels
are left out, repeated labels of an id count once (the smallest), as do
repeated documents of an id (those with the smallest features). With no
labels every score is 1, so nothing is rejected; with one class only, all
scores are its smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import fresh, text_batches

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
FEATURES = ["log_chars", "word_length", "upper", "digit", "symbol", "comma_stop", "blank", "distinct_words", "repeated_next", "log_line", "distinct_lines", "ended_lines", "bars", "marks", "longest_word", "other_bytes", "bang"]


def _classes() -> np.ndarray:
    """Byte to class: 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 comma or full stop, 6 bar, 7 exclamation or question mark, 8 other symbol, 9 not ASCII."""
    c = np.zeros(256, np.int64)
    c[128:] = 9
    for b in range(33, 127):
        ch = chr(b)
        c[b] = 1 if ch.isupper() else 2 if ch.islower() else 3 if ch.isdigit() else 5 if ch in ",.;:'\"-()" else 6 if ch == "|" else 7 if ch in "!?" else 8
    c[[9, 10, 11, 12, 13, 32]] = 4
    return c


CLASSES = _classes()


def features(text: str) -> list[float]:
    """FEATURES of a whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) if raw else np.zeros(10)
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    ln = max(1, len(lines))
    letters = max(1.0, counts[1] + counts[2])
    return [
        np.log1p(len(text)), sum(map(len, words)) / w, counts[1] / letters, counts[3] / n, counts[8] / w, counts[5] / w, counts[4] / n, len(set(words)) / w,
        sum(map(str.__eq__, words, words[1:])) / w, np.log1p(len(text) / ln), len(set(lines)) / ln, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / ln, counts[6] / w, counts[7] / w, np.log1p(max(map(len, words), default=0)), counts[9] / n, text.count("!!") / w,
    ]


@dataclass
class Gam:
    """Cut points of each feature, its table, and tables of pairs."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray | float, h: np.ndarray | float, ridge: float):
    return g / (h + ridge)


def _gain(g, h, ridge: float):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A piecewise constant table over bins: the widest gain is split first."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    while len(spans) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gt, ht = g[a:b].sum(), h[a:b].sum()
                gain = _gain(gl, hl, ridge) + _gain(gt - gl, ht - hl, ridge) - _gain(gt, ht, ridge)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), k, a + at + 1))
        if not best[2]:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, table) of the best cross of one cut in each of two features: four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, b, c = cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1]
    ah, bh, chh = ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]
    d, dh = gt - a - b - c, ht - ah - bh - chh
    gain = sum(_gain(x, y, ridge) for x, y in ((a, ah), (b, bh), (c, chh), (d, dh)))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = _leaf(a[i, j], ah[i, j], ridge), _leaf(b[i, j], bh[i, j], ridge)
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = _leaf(c[i, j], chh[i, j], ridge), _leaf(d[i, j], dh[i, j], ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 1.0) -> Gam:
    """Fit by cyclic boosting: first single features, then the pairs with the largest gain on what is left."""
    share = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
    if len(y) == 0 or y.min() == y.max():
        share = share if len(y) == 0 or y.max() else 1 / (len(y) + 2)
        return Gam(float(np.log(share / max(1e-13, 1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), leaves, ridge)
            t += step
            total += step[b[:, j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        ni, nj = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * nj + b[:, j], v, ni * nj).reshape(ni, nj)

    g, h = slopes()
    ranked = sorted(((_tree2(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for _, i, j in ranked]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), ridge)[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"id": b.column(1), "y": b.column(2), "x": pa.array([features(t) for t in pc.fill_null(b.column(0).cast(pa.string()), "").to_pylist()], pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", use: Column | None = None, sample: int = SAMPLE) -> Gam:
    """Fit on at most ``sample`` labelled documents; ``use`` is the condition on the id of those that may be learnt from."""
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
    if use is not None:
        rows = rows.where(use)
    chosen = rows.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows of two numbers are broadcast
    text_batches(docs.sparkSession)
    read = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    picked = read.join(F.broadcast(chosen), "_id").select("text", F.xxhash64("_id").alias("id"), "_y")
    rows = picked.mapInArrow(_feature_rows, "id bigint, y double, x array<double>")
    # an id that repeats counts once, with its least row, so no more than ``sample`` rows come to the driver
    found = rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("row")).select("row.x", "row.y").toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(found.num_rows, len(FEATURES))
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the order of rows doesn't depend on the partitions
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score, 0 to 1, of each whole text to the columns ``keep`` (all if None)."""
    rest = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(*[F.col(c) for c in rest], F.col(text).cast("string").alias(f"{fresh(rest)}text"))
    schema = docs.select(*rest).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in pc.fill_null(b.column(len(rest)), "").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(model.score(x))], names=schema.names)

    text_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

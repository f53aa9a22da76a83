"""Vectors as arrays, in native higher-order functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; a zero vector has similarity 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: str | Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def clamp(sim: str | Column, least: float = 0.0) -> Column:
    """max(least, sim)."""
    return F.greatest(col(sim), F.lit(least))


def rescale(sim: str | Column) -> Column:
    """Similarity from [-1, 1] to [0, 1]."""
    return (col(sim) + 1) / 2


def splade_pool(logits: str | Column) -> Column:
    """log(1 + relu) of the largest activation of each term."""
    return F.log1p(F.greatest(F.array_max(col(logits)), F.lit(0.0)))


def masked_mean(states: str | Column, mask: str | Column) -> Column:
    """The mean of the state vectors whose mask is 1; null if there is none."""
    kept = F.filter(F.zip_with(col(states), col(mask), lambda s, m: F.when(m == 1, s)), lambda s: s.isNotNull())
    n = F.size(kept)
    total = F.aggregate(F.slice(kept, 2, F.greatest(n - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))

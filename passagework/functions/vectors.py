"""Vector arithmetic as Column expressions, in double precision and in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column, b: Column) -> Column:
    def step(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _sum(F.zip_with(a, b, step))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def score(distance: Column) -> Column:
    """Squared distance as a similarity between 0 and 1, at four decimals."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(2.0)), 4)


def radius_of(threshold: float) -> float:
    """A squared distance that no hit with a rounded score of at least ``threshold`` exceeds."""
    return float("inf") if threshold <= 0 else 2 * (1 - threshold) + 2e-4

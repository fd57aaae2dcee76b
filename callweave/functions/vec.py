"""Column expressions over vectors kept as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside ``transform`` an outer expression would be evaluated again for every
    element; passing it through a one-element array binds it first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(F.greatest(norm(a), F.lit(EPS)), lambda n: F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return dot(a, b) / F.when(scale == 0, F.lit(EPS)).otherwise(scale)

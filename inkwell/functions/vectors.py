"""Vector functions as columns: arrays of any number type, sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def blend(query: Column, other: Column, alpha: Column) -> Column:
    """(1 - alpha) * query + alpha * other, of unit length."""
    return normalise(F.zip_with(query, other, lambda q, h: (1 - alpha) * q.cast("double") + alpha * h.cast("double")))

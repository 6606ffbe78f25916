"""Dense vectors as array<double> columns: all in whole-stage code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column, p: float = 2.0) -> Column:
    if p < 1:
        raise ValueError("p must be at least 1")
    if p == float("inf"):
        return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))
    if p == 1:
        return total(F.transform(a, F.abs))
    if p == 2:
        return F.sqrt(dot(a, a))
    return F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: F.lit(float(alpha)) * u + v)


def scale(alpha: float, x: Column) -> Column:
    return F.transform(x, lambda u: F.lit(float(alpha)) * u)


def argmax(a: Column) -> Column:
    """First place of the largest component, from 0; -1 for an empty vector."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).otherwise(F.lit(-1)).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def nonzeros(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x != 0)).cast("bigint")


def is_sparse_smaller(a: Column) -> Column:
    """Whether the sparse form takes less room: 1.5 (nonzeros + 1) < size."""
    return F.lit(1.5) * (nonzeros(a) + 1) < F.size(a)

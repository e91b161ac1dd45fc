"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zero."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def mat_vec(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / total(e))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -40.0, 40.0)))


def relu(xs: Column) -> Column:
    return F.transform(xs, lambda z: F.greatest(F.lit(0.0), z))


def log_loss(p: Column, y: Column) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))

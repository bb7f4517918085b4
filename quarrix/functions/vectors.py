"""Vectors as arrays of floats; products and sums are computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length in single precision; zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def fitted(v: Column, dimension: int) -> Column:
    """Cut to the dimension, or padded with zeros up to it; null vectors stay."""
    padded = F.concat(v.cast("array<float>"), F.array_repeat(F.lit(0).cast("float"), F.greatest(dimension - F.size(v), F.lit(0))))
    return F.when(v.isNotNull(), F.slice(padded, 1, dimension))

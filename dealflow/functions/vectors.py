"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` between 0 and 2; NULL when either vector is missing or all zero.

    For a pair of columns on one row. Searching a table goes through ``operators.knn``, which multiplies whole
    Arrow batches instead.
    """
    size = norm(a) * norm(b)
    distance = F.lit(1.0) - dot(a, b) / size
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance)))


def similarity(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 4)

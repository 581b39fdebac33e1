"""Vector distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in 0..2; a zero vector is at distance 1 from everything."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(F.lit(1.0))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 2)

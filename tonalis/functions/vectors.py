"""Vector measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length of two arrays."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the common length; 0 if a norm is 0."""
    k = F.least(F.size(a), F.size(b))
    n = norm(F.slice(a, 1, k)) * norm(F.slice(b, 1, k))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    """The vector at length 1; itself if its norm is 0."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def circular_mean(angle: Column, weight: Column) -> Column:
    """The weighted mean of hues from 0 to 1, as an aggregate."""
    turn = 6.283185307179586
    h = F.atan2(F.sum(F.sin(angle * turn) * weight), F.sum(F.cos(angle * turn) * weight)) / turn
    return F.when(h < 0, h + 1).otherwise(h)

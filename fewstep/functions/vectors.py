"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v) -> Column:
    """v over its length; the tiny addend keeps a zero vector zero."""
    v = doubles(v)
    # The length is an element of an array, so it is taken once for a vector, not for each of its numbers.
    return F.get(F.transform(F.array(norm(v) + F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))


def cosine(a, b) -> Column:
    """Null when a side is null or has length 0."""
    a, b = doubles(a), doubles(b)
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))

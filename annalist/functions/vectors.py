"""Vector maths on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """In [-1, 1]; null for null or zero vectors, so that a failed encoding matches nothing."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def unit_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity scaled to [0, 1]."""
    return (cosine_similarity(a, b) + 1) / 2


def l2_normalise(a: Column) -> Column:
    """The vector of length one; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: (x.cast("double") / norm(a)).cast("float")))


def is_usable(a: Column, dimension: int) -> Column:
    """Present, of the right length, without NaN and not zero."""
    return F.coalesce((F.size(a) == dimension) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (norm(a) > 0), F.lit(False))

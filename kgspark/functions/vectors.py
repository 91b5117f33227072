"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-10


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where either norm is under the guard or not a number, or the lengths differ."""
    d = norm(a) * norm(b)
    ok = (norm(a) >= GUARD) & (norm(b) >= GUARD) & ~F.isnan(d) & (F.size(a) == F.size(b))
    return F.when(ok, dot(a, b) / d)


def is_usable(v: Column, dim: int) -> Column:
    n = norm(v)
    return v.isNotNull() & (F.size(v) == dim) & ~F.isnan(n) & (n < float("inf")) & (n >= GUARD)


def unit(v: Column) -> Column:
    n = norm(v) + GUARD
    return F.transform(_double(v), lambda x: x / n)


def legacy_similarity(distance: Column) -> Column:
    return F.round(1 - distance / 2, 4)


def parse_vector(c: Column) -> Column:
    """A vector written as a list literal; null where it is none."""
    return F.from_json(c, "array<float>")

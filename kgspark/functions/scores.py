"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def bounded(x: Column, lo: Column, hi: Column) -> Column:
    """Linear in [lo, hi], 1 where the bounds meet."""
    return F.when(hi == lo, F.lit(1.0)).otherwise(clip((x - lo) / F.nullif(hi - lo, F.lit(0.0))))


def inverted(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(1.0)).otherwise(1 - bounded(x, lo, hi))


def on_target(x: Column, target: Column, span: Column) -> Column:
    """1 at the target, falling linearly to 0 at ``span`` away."""
    return F.when(span == 0, F.lit(1.0)).otherwise(clip(1 - F.abs(x - target) / F.nullif(span, F.lit(0.0))))


def sigmoid(dev: Column, scale: float) -> Column:
    return 1 / (1 + F.exp(dev / scale))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))

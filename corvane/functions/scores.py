"""Scores as column expressions. Null means that a score does not apply; it is never taken for 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    """x, 0 where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines round doubles: x times their power of ten to the nearest whole number, halves away
    from zero. F.round goes by the decimal digits that are printed, which are on the other side of a half now and then."""
    x = x.cast("double")
    out = F.round(x * 10.0**places) / 10.0**places
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def rescale(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / (high - low))


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are not null, by their weights; null if all are."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(total, weight)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, (0, 0) for n = 0."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return tuple(F.when(n == 0, 0.0).otherwise(clip(x)) for x in (mid - half, mid + half))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or zero vectors."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)

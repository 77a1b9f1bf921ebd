"""Scores and levels as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def level(score: Column, bounds: dict[str, float], otherwise: str) -> Column:
    """The first level whose bound the score reaches."""
    out = F.lit(otherwise)
    for name, bound in reversed(bounds.items()):
        out = F.when(score >= bound, name).otherwise(out)
    return out


#: Levels of a completeness score and of a match score.
QUALITY = {"excellent": 0.9, "good": 0.7, "fair": 0.5, "poor": 0.3}
MATCH = {"high": 0.7, "medium": 0.4}


def years_tier(years: Column, least: float) -> Column:
    """0.35, 0.20 or 0.10 from 100, 70 or 50 % of the years asked for; else 0."""
    return F.when(years >= least, 0.35).when(years >= least * 0.7, 0.20).when(years >= least * 0.5, 0.10).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 for a zero vector."""
    wide = lambda v: v.cast("array<double>")
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = add(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(wide(a), lambda x: x * x))) * F.sqrt(add(F.transform(wide(b), lambda x: x * x)))
    return F.coalesce(F.try_divide(dot, norm), F.lit(0.0))


def reciprocal_rank(rank: Column, weight: float, k: int = 60) -> Column:
    return F.coalesce(F.lit(weight) / (k + rank), F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))

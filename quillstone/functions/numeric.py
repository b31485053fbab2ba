"""Rounding and distance expressions that the operators share; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(x: Column) -> Column:
    """A colour channel: rounded half to even, held between 0 and 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x.cast("double")).cast("int")))


def fixed(x: Column, scale: float = 1e6) -> Column:
    """A fixed-point integer of ``x``, rounded half to even: equal in every engine where doubles are."""
    return F.rint(x.cast("double") * F.lit(float(scale))).cast("long")


def luma_scaled(r: Column, g: Column, b: Column) -> Column:
    """Ten thousand times the luma, as an integer."""
    return F.lit(2126) * r + F.lit(7152) * g + F.lit(722) * b


def luma(r: Column, g: Column, b: Column) -> Column:
    return luma_scaled(r, g, b) / F.lit(10000.0)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda acc, d: acc + d)


def unit_similarity(distance_squared: Column, features: int, scale: float) -> Column:
    """1 - distance / sqrt(features), at least 0, for features that were scaled by ``scale`` to integers."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(distance_squared.cast("double")) / F.lit(scale) / F.sqrt(F.lit(float(features))))

"""Column expressions of the engine: no rows move and no Python runs in any of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, and 0 where that has no value."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0: NDVI of nir and red, NDWI of green and nir."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(guarded(a - b, a + b))


def quantized(x: Column, low: Column, high: Column, levels: int) -> Column:
    """Gray level 0 to levels - 1 of x in [low, high], cut off, not rounded; 0 where the band is constant."""
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(levels - 1)), guarded(x - low, high - low) * (levels - 1))))
    return F.when(high > low, level).otherwise(F.lit(0)).cast("int")


def scaled_10000(x: Column, low: Column, high: Column) -> Column:
    """x in [low, high] as a whole number from 0 to 10000; 0 where both are equal."""
    return F.floor(guarded(x - low, high - low) * 10000).cast("int")


def as_uint8(x: Column, high: Column) -> Column:
    """x as 0 to 255: values of images that go up to 1 at most are multiplied by 255 first."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.when(high <= 1, x * 255).otherwise(x)))).cast("int")


def membership(x: Column, low: float, high: float, low_edge: float | None = None, high_edge: float | None = None) -> Column:
    """Trapezoid: 1 from low to high, straight ramps from low_edge and to high_edge, else 0. NaN and null give 0."""
    a, d = low if low_edge is None else low_edge, high if high_edge is None else high_edge
    out = F.when(x.isNull() | F.isnan(x), 0.0).when((x >= low) & (x <= high), 1.0)
    if a < low:
        out = out.when((x >= a) & (x < low), (x - a) / F.lit(float(low - a)))
    if d > high:
        out = out.when((x > high) & (x <= d), 1 - (x - high) / F.lit(float(d - high)))
    return out.otherwise(0.0)


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, guarded(area * (4 * math.pi), perimeter * perimeter)).otherwise(0.0)


def grid_row_col(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(row, col) of a map coordinate under an affine transform (a, b, c, d, e, f): x = a col + b row + c and so on."""
    a, b, c, d, e, f = map(float, transform)
    det = a * e - b * d
    col = ((x - c) * e - (y - f) * b) / det
    row = ((y - f) * a - (x - c) * d) / det
    return F.floor(row).cast("int"), F.floor(col).cast("int")

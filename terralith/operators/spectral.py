"""Spectral features: one aggregation of the pixels by segment, then projections of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalized_difference
from .labels import keys, segments_of


def band_columns(px: DataFrame) -> list[str]:
    return sorted((c for c in px.columns if c[0] == "b" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def named_bands(n: int, names: list[str] | dict[str, int] | None) -> list[str]:
    """A name for each of n bands: of a list the first n, of a dict those with their index, else band_i."""
    if isinstance(names, dict):
        by = {i: name for name, i in names.items()}
        return [by.get(i, f"band_{i}") for i in range(n)]
    names = list(names or [])[:n]
    return names + [f"band_{i}" for i in range(len(names), n)]


def feature_names(n: int, names: list[str] | dict[str, int] | None = None, ratios: bool = True) -> list[str]:
    bands = named_bands(n, names)
    out = [f"{s}_{b}" for b in bands for s in ("mean", "std", "min", "max", "median")] + [f"range_{b}" for b in bands] + ["brightness"]
    if ratios and isinstance(names, dict):
        out += ["ndvi"] * ({"nir", "red"} <= set(names)) + ["ndwi"] * ({"green", "nir"} <= set(names))
    return out


def spectral(px: DataFrame, names: list[str] | dict[str, int] | None = None, ratios: bool = True, nodata: float | None = None, exact_median: bool = True) -> DataFrame:
    """mean, std (of the population), min, max, median and range of each band, brightness, and from bands named by a
    dict the NDVI and NDWI, for each segment.

    A pixel with nodata in any band counts for no statistic, but its segment stays: one of such pixels only has
    nulls. exact_median=False takes the approximate percentile, whose state is bounded for segments of any size.
    """
    columns = band_columns(px)
    bands = named_bands(len(columns), names)
    bad = None
    if nodata is not None:
        for c in columns:
            bad = (F.col(c) == nodata) if bad is None else bad | (F.col(c) == nodata)
    value = lambda c: F.col(c).cast("double") if bad is None else F.when(~bad, F.col(c).cast("double"))
    middle = F.median if exact_median else lambda x: F.percentile_approx(x, 0.5, 10_000)
    out = segments_of(px).groupBy(*keys(px)).agg(
        *(f(value(c)).alias(f"{s}_{b}") for c, b in zip(columns, bands, strict=True) for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("median", middle)))
    )
    derived = {f"range_{b}": F.col(f"max_{b}") - F.col(f"min_{b}") for b in bands}
    total = sum((F.col(f"mean_{b}") for b in bands[1:]), F.col(f"mean_{bands[0]}")) if bands else F.lit(None)
    derived["brightness"] = total / F.lit(float(max(1, len(bands))))
    if ratios and isinstance(names, dict):
        if {"nir", "red"} <= set(names):
            derived["ndvi"] = normalized_difference(F.col("mean_nir"), F.col("mean_red"))
        if {"green", "nir"} <= set(names):
            derived["ndwi"] = normalized_difference(F.col("mean_green"), F.col("mean_nir"))
    return out.select("*", *(c.alias(n) for n, c in derived.items()))

"""Texture features: gray-level co-occurrence within segments, as an equi-join of pixels and counts of pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded, quantized
from .labels import image, keys, segments_of
from .spectral import band_columns

PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")
DISTANCES = (1,)
ANGLES = (0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)
#: Segments of fewer pixels have no texture: all their properties are 0.
LEAST_PIXELS = 4


def offsets(distances: tuple = DISTANCES, angles: tuple = ANGLES) -> list[tuple[int, int]]:
    """(rows, columns) to the other pixel, for each distance and angle."""
    return [(round(math.sin(a) * d), round(math.cos(a) * d)) for d in distances for a in angles]


def gray_levels(px: DataFrame, levels: int = 32, bands: list[int] | None = None) -> DataFrame:
    """px with its bands as gray levels between each image's least and largest value, nodata pixels included."""
    columns = [c for c in band_columns(px) if bands is None or int(c[1:]) in bands]
    ends = px.groupBy(*image(px)).agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    joined = px.join(F.broadcast(ends), image(px)) if image(px) else px.join(F.broadcast(ends))  # a row for each image
    return joined.select(*keys(px), "row", "col", *(quantized(F.col(c).cast("double"), F.col(f"low_{c}"), F.col(f"high_{c}"), levels).alias(c) for c in columns))


def cooccurrence(px: DataFrame, levels: int = 32, bands: list[int] | None = None, distances: tuple = DISTANCES, angles: tuple = ANGLES) -> DataFrame:
    """band, pair (of the offset), i, j, n: how often gray levels i and j, of which i is the lesser, lie at the offset
    from each other in a segment, in either direction. Pixels are dealt by place, so a segment of any size is spread; its
    counts are summed before they move."""
    by = keys(px)
    gray = segments_of(gray_levels(px, levels, bands))
    columns = band_columns(gray)
    values = F.array(*[F.col(c) for c in columns])
    steps = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(offsets(distances, angles))])
    left = gray.select(*by, "row", "col", values.alias("i"), F.explode(steps).alias("s")).select(*by, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "i", "s.pair")
    pairs = left.join(gray.select(*by, "row", "col", values.alias("j")), [*by, "row", "col"])
    each = pairs.select(*by, "pair", F.explode(F.arrays_zip(F.lit([int(c[1:]) for c in columns]).cast("array<int>").alias("band"), "i", "j")).alias("x"))
    return each.groupBy(*by, "x.band", "pair", F.least("x.i", "x.j").alias("i"), F.greatest("x.i", "x.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def texture(px: DataFrame, levels: int = 32, bands: list[int] | None = None, distances: tuple = DISTANCES, angles: tuple = ANGLES) -> DataFrame:
    """glcm_{property}_b{band} for each segment, the mean over distances and angles.

    The matrices are symmetric. An offset without pairs in a segment counts as 0, for the correlation as 1, as do
    matrices without spread. Sums are taken over whole numbers, and divided once, so their order doesn't matter.
    """
    by = keys(px)
    n_pairs = len(offsets(distances, angles))
    chosen = [int(c[1:]) for c in band_columns(px) if bands is None or int(c[1:]) in bands]
    counts = cooccurrence(px, levels, bands, distances, angles)
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    # of the symmetric matrix: (i, j) and (j, i) hold n each, (i, i) holds 2 n
    gap = j - i
    sums = counts.groupBy(*by, "band", "pair").agg(
        F.sum(2 * n).alias("all"), F.sum(2 * n * gap * gap).alias("contrast"), F.sum(2 * n * gap).alias("dissimilarity"), F.sum(2 * n / (1 + gap * gap)).alias("homogeneity"),
        F.sum(n * n * F.when(i == j, 4).otherwise(2)).alias("energy"), F.sum(n * (i + j)).alias("si"), F.sum(n * (i * i + j * j)).alias("sii"), F.sum(2 * n * i * j).alias("sij"),
    )
    whole = F.col("all")
    spread = whole * F.col("sii") - F.col("si") * F.col("si")
    values = sums.select(
        *by, "band", "pair",
        (F.col("contrast") / whole).alias("contrast"), (F.col("dissimilarity") / whole).alias("dissimilarity"), (F.col("homogeneity") / whole).alias("homogeneity"),
        (F.sqrt("energy") / whole).alias("energy"),
        F.when(spread == 0, 1.0).otherwise(guarded(whole * F.col("sij") - F.col("si") * F.col("si"), spread)).alias("correlation"),
    )
    sizes = segments_of(px).groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    means = values.groupBy(*by).agg(*(
        # one column for each offset keeps the order of the sum fixed; a missing one counts as above
        (sum((F.coalesce(F.max(F.when((F.col("band") == b) & (F.col("pair") == k), F.col(p))), F.lit(1.0 if p == "correlation" else 0.0)) for k in range(n_pairs)), F.lit(0.0)) / n_pairs).alias(f"glcm_{p}_b{b}")
        for b in chosen for p in PROPERTIES
    ))
    absent = {f"glcm_{p}_b{b}": 1.0 if p == "correlation" else 0.0 for b in chosen for p in PROPERTIES}
    joined = sizes.join(means, by, "left")
    return joined.select(*by, *(F.when(F.col("_size") < LEAST_PIXELS, 0.0).otherwise(F.coalesce(c, F.lit(v))).alias(c) for c, v in absent.items()))

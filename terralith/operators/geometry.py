"""Shape of segments: moments by one aggregation, perimeter by votes of neighbouring pixels, solidity by hulls.

Votes replace self-joins: a pixel is exploded to its neighbours' places, and a place's votes are summed where the
same segment has a pixel. The keys are places, so that a segment of any size is spread over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compactness, guarded
from .labels import keys, segments_of

SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))
CORNERS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
#: Length that a border pixel adds, by 1 + 2 times its border neighbours at the sides + 10 times those at the corners.
BORDER_LENGTH = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


def _votes(pixels: DataFrame, by: list[str], offsets: tuple, name: str) -> DataFrame:
    """pixels with, as name, how many of the offsets lead from them to other rows of pixels with the same keys."""
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c"), F.lit(0).alias("own")) for a, b in offsets], F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1).alias("own")))
    cast = pixels.select(*by, "row", "col", F.explode(steps).alias("s")).select(*by, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("s.own").alias("own"))
    return cast.groupBy(*by, "row", "col").agg(F.sum("own").alias("_own"), F.sum(1 - F.col("own")).alias(name)).where("_own > 0").drop("_own")


def border(px: DataFrame) -> DataFrame:
    """Pixels of each segment that lack a neighbour of their segment at a side."""
    by = keys(px)
    return _votes(segments_of(px).select(*by, "row", "col"), by, SIDES, "n").where("n < 4").drop("n")


def perimeter(px: DataFrame) -> DataFrame:
    """Length of each segment's border, from centre to centre of its border pixels."""
    by = keys(px)
    edge = border(px)
    # both kinds of neighbours in one pass: a side counts 2, a corner 10
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c"), F.lit(w).alias("w"), F.lit(0).alias("own")) for offsets, w in ((SIDES, 2), (CORNERS, 10)) for a, b in offsets], F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1).alias("w"), F.lit(1).alias("own")))
    cast = edge.select(*by, "row", "col", F.explode(steps).alias("s")).select(*by, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "s.w", "s.own")
    codes = cast.groupBy(*by, "row", "col").agg(F.sum("own").alias("own"), F.sum("w").alias("code")).where("own > 0")
    # whole counts of each length, so that the order of the rows doesn't matter
    counts = [F.sum(F.when(F.col("code").isin(*c), 1).otherwise(0)).alias(f"_n{k}") for k, c in enumerate(BORDER_LENGTH.values())]
    length = sum((F.col(f"_n{k}") * F.lit(w) for k, w in enumerate(BORDER_LENGTH)), F.lit(0.0))
    return codes.groupBy(*by).agg(*counts).select(*by, length.alias("perimeter"))


def moments(px: DataFrame) -> DataFrame:
    """area_px, bounds, centroid, axes, eccentricity and orientation of each segment."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    sums = segments_of(px).groupBy(*keys(px)).agg(
        F.count(F.lit(1)).alias("area_px"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"),
        F.avg(r).alias("centroid_y"), F.avg(c).alias("centroid_x"),
        F.avg(r * r).alias("_rr"), F.avg(c * c).alias("_cc"), F.avg(r * c).alias("_rc"),
    )
    at = sums.withColumns({"_20": F.col("_rr") - F.col("centroid_y") ** 2, "_02": F.col("_cc") - F.col("centroid_x") ** 2, "_11": F.col("_rc") - F.col("centroid_y") * F.col("centroid_x")})
    middle = (F.col("_20") + F.col("_02")) / 2
    spread = F.sqrt(((F.col("_20") - F.col("_02")) / 2) ** 2 + F.col("_11") ** 2)
    at = at.withColumns({"_l1": F.greatest(F.lit(0.0), middle + spread), "_l2": F.greatest(F.lit(0.0), middle - spread)})
    level = F.when(F.col("_11") > 0, math.pi / 4).otherwise(-math.pi / 4)
    turned = F.atan2(2 * F.col("_11"), F.col("_20") - F.col("_02")) / 2
    out = at.withColumns({
        "eccentricity": F.when(F.col("_l1") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_l2"), F.col("_l1"))))).otherwise(0.0),
        "major_axis_length": 4 * F.sqrt("_l1"),
        "minor_axis_length": 4 * F.sqrt("_l2"),
        "orientation": F.when(F.col("_20") == F.col("_02"), level).otherwise(turned),
    })
    return out.drop("_rr", "_cc", "_rc", "_20", "_02", "_11", "_l1", "_l2")


def hull_pixels(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of a segment's pixels, each taken as the four points half a pixel
    from its centre. Of each row of the segment, only the first and last pixel can be on the hull."""
    points = sorted({(r + dr, c + dc) for r, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True) for c in {a, b} for dr, dc in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))})

    def half(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    hull = half(points)[:-1] + half(points[::-1])[:-1]
    n = 0
    for r in range(int(rows.min()), int(rows.max()) + 1):
        across = []
        for (r1, c1), (r2, c2) in zip(hull, hull[1:] + hull[:1], strict=True):
            if min(r1, r2) <= r <= max(r1, r2):
                across += [c1, c2] if r1 == r2 else [c1 + (c2 - c1) * (r - r1) / (r2 - r1)]
        n += math.floor(max(across) + 1e-9) - math.ceil(min(across) - 1e-9) + 1
    return n


def solidity(px: DataFrame) -> DataFrame:
    """Pixels of each segment over those of its convex hull. Python gets two numbers for each row of a segment, and
    many segments at a time."""
    by = keys(px)
    spans = segments_of(px).groupBy(*by, "row").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.count(F.lit(1)).alias("n"))
    whole = spans.groupBy(*by).agg(F.collect_list(F.struct("row", "first", "last")).alias("spans"), F.sum("n").alias("n"))

    @F.pandas_udf("bigint")
    def hulls(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([hull_pixels(*x) for x in zip(rows, first, last, strict=True)], dtype="int64")

    return whole.select(*by, (F.col("n") / hulls(F.col("spans")["row"], F.col("spans")["first"], F.col("spans")["last"])).alias("solidity"))


FEATURES = "area_px perimeter eccentricity solidity major_axis_length minor_axis_length orientation centroid_y centroid_x area compactness elongation rectangularity".split()


def geometry(px: DataFrame, pixel_size: float | None = None) -> DataFrame:
    """The features of each segment's shape. pixel_size (1 if none) scales area and perimeter; axes and centroid
    stay in pixels. What would divide by 0 is 0."""
    by, size = keys(px), float(pixel_size or 1.0)
    out = moments(px).join(perimeter(px), by).join(solidity(px), by)
    box: Column = (F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)
    area = F.col("area_px") * F.lit(size * size)
    out = out.withColumns({"area": area, "_p": F.col("perimeter"), "perimeter": F.col("perimeter") * F.lit(size)})
    out = out.withColumns({
        "compactness": compactness(F.col("area"), F.col("perimeter")),
        "elongation": F.when(F.col("minor_axis_length") > 0, guarded(F.col("major_axis_length"), F.col("minor_axis_length"))).otherwise(0.0),
        "rectangularity": guarded(F.col("area_px"), box),
    })
    return out.select(*by, *FEATURES)

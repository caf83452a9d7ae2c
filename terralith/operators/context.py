"""Neighbourhood of segments: adjacency by equi-joins of pixels to the next row and column, then aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import image, keys, segments_of
from .spectral import band_columns


def adjacency(px: DataFrame) -> DataFrame:
    """src, dst: pairs of segments with pixels side by side, in both directions. Nodata is no neighbour.

    Each pixel is sent to the places right of it and below it; pairs are made distinct before they move on.
    """
    by = image(px)
    own = segments_of(px).select(*by, "row", "col", "segment_id")
    steps = F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))
    sent = own.select(*by, F.col("segment_id").alias("src"), "row", "col", F.explode(steps).alias("s"))
    sent = sent.select(*by, "src", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    met = sent.join(own, [*by, "row", "col"]).where("src <> segment_id").select(*by, "src", F.col("segment_id").alias("dst")).distinct()
    return met.union(met.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def context(px: DataFrame) -> DataFrame:
    """n_neighbors, mean_neighbor_brightness, std_neighbor_brightness and border_contrast of each segment.

    The mean and the deviation (of the population) are over the means of all bands of all neighbours together; the
    contrast is the mean over neighbours of the mean over bands of the distance of the means. Without neighbours
    all are 0.
    """
    by, columns = image(px), band_columns(px)
    means = segments_of(px).groupBy(*keys(px)).agg(F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("m"))
    edges = adjacency(px)
    a = means.select(*by, F.col("segment_id").alias("src"), F.col("m").alias("own"))
    b = means.select(*by, F.col("segment_id").alias("dst"), F.col("m").alias("other"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    n = float(len(columns))
    met = edges.join(b, [*by, "dst"]).join(a, [*by, "src"]).select(
        *by, "src", total("other").alias("s"), total(F.transform("other", lambda v: v * v)).alias("ss"),
        (total(F.zip_with("own", "other", lambda x, y: F.abs(x - y))) / n).alias("d"),
    )
    sums = met.groupBy(*by, F.col("src").alias("segment_id")).agg(
        F.count(F.lit(1)).alias("n_neighbors"), (F.avg("s") / n).alias("mean_neighbor_brightness"), (F.avg("ss") / n).alias("_squares"), F.avg("d").alias("border_contrast")
    )
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") - F.col("mean_neighbor_brightness") ** 2))
    sums = sums.withColumn("std_neighbor_brightness", deviation)
    ids = means.select(*keys(px))
    return ids.join(sums, keys(px), "left").select(
        *keys(px), F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"),
        *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_neighbor_brightness", "std_neighbor_brightness", "border_contrast")),
    )

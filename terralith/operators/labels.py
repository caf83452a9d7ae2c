"""Labels of a pixel relation (image_id, row, col, segment_id, bands): counts, sizes, bounds, renumbering.

image_id is optional everywhere; where it is there, every operator works on each image by itself. Segment 0 is
nodata: its pixels are rows, but it is never a segment.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image(df: DataFrame) -> list[str]:
    return ["image_id"] if "image_id" in df.columns else []


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read from the session's checkpoint folder from then on. Only where none is set, as in
    tests on one machine, a temporary folder is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="terralith-"))
    return df.checkpoint()


def keys(df: DataFrame) -> list[str]:
    return [*image(df), "segment_id"]


def segments_of(px: DataFrame) -> DataFrame:
    """Pixels of segments, without nodata."""
    return px.where("segment_id > 0")


def mask_labels(px: DataFrame, mask: Column) -> DataFrame:
    """px with segment 0 where mask holds."""
    return px.withColumn("segment_id", F.when(mask, F.lit(0)).otherwise(F.col("segment_id")))


def count_segments(px: DataFrame) -> DataFrame:
    """n_segments, for each image where there are images. Without segments: 0, or no row for the image."""
    return segments_of(px).groupBy(*image(px)).agg(F.countDistinct("segment_id").alias("n_segments"))


def segment_sizes(px: DataFrame) -> DataFrame:
    """Pixels of each segment."""
    return segments_of(px).groupBy(*keys(px)).agg(F.count(F.lit(1)).alias("size"))


def segment_slices(px: DataFrame) -> DataFrame:
    """Bounds of each segment, the ends excluded."""
    return segments_of(px).groupBy(*keys(px)).agg(
        F.min("row").alias("row_start"), (F.max("row") + 1).alias("row_stop"), F.min("col").alias("col_start"), (F.max("col") + 1).alias("col_stop")
    )


def sequential_ids(px: DataFrame) -> DataFrame:
    """segment_id, new_id: 1 to K in ascending order of the ids there are.

    The rank is taken over the distinct ids; those of one image meet in one task unless they are first counted by
    range, so ids are dealt into ranges of 2^16 whose counts are summed up.
    """
    ids = segments_of(px).select(*keys(px)).distinct().withColumn("_range", F.shiftright("segment_id", 16))
    by = image(px)
    counts = ids.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_range", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("segment_id"))
    return ids.withColumn("_rank", rank).join(offsets, [*by, "_range"]).select(*keys(px), (F.col("_rank") + F.col("_before")).cast("int").alias("new_id"))


def relabel_sequential(px: DataFrame) -> DataFrame:
    """px with its segments renumbered 1 to K; 0 stays."""
    new = sequential_ids(px)
    out = px.join(new, keys(px), "left").withColumn("segment_id", F.coalesce("new_id", F.lit(0)))
    return out.select(*px.columns)

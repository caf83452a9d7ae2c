"""Summaries of feature tables and classifications, and rasters of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import guarded
from .labels import image, keys


def class_frequency(predictions: DataFrame, column: str = "class_label") -> DataFrame:
    """class_label, count, pct (to one place): most frequent first."""
    counts = predictions.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_all"))
    out = counts.join(F.broadcast(total))  # one row
    return out.select(column, "count", F.round(F.col("count") * 100 / F.col("_all"), 1).alias("pct")).orderBy(F.desc("count"), column)


def sample_count(samples: DataFrame, column: str = "class_label") -> DataFrame:
    return samples.groupBy(column).agg(F.count(F.lit(1)).alias("n_samples"))


def numeric_features(features: DataFrame) -> list[str]:
    return [f.name for f in features.schema if isinstance(f.dataType, T.NumericType) and f.name not in ("image_id", "segment_id")]


def valid(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def feature_summary(features: DataFrame) -> DataFrame:
    """feature, min, max, mean, std (of the sample), median and count, without NaN and null: one pass over the rows."""
    names = numeric_features(features)
    if not names:
        return features.sparkSession.createDataFrame([], "feature string, min double, max double, mean double, std double, median double, count bigint")
    stats = (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp), ("median", F.median), ("count", F.count))
    one = features.agg(*(f(valid(c)).alias(f"{c}|{s}") for c in names for s, f in stats))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *(F.col(f"`{c}|{s}`").alias(s) for s, _ in stats)) for c in names]))
    return one.select(rows.alias("r")).select("r.*").orderBy("feature")


def bins_for(rows: int) -> int:
    return min(50, max(10, rows // 20))


def histogram(features: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """bin (from 0), low, high, n: equal intervals between the least and largest value, the last one closed.

    Without bins there are a twentieth of the values', from 10 to 50. A constant column has all in bin 0.
    """
    values = features.select(valid(column).alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    size = F.lit(bins) if bins else F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("n") / 20)))
    ends = ends.select("low", "high", size.cast("int").alias("size")).where("low is not null")
    place = F.least(F.col("size") - 1, F.floor(guarded((F.col("v") - F.col("low")) * F.col("size"), F.col("high") - F.col("low")))).cast("int")
    counts = values.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("high") - F.col("low")) / F.col("size")
    every = ends.select("low", width.alias("w"), F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("low") + F.col("w") * F.col("bin")).alias("low"), (F.col("low") + F.col("w") * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def equal_intervals(features: DataFrame, column: str, classes: int = 5) -> DataFrame:
    """segment_id, interval (0 to classes - 1; 3 to 20 classes) of each value that isn't NaN or null."""
    if not 3 <= classes <= 20:
        raise ValueError(f"classes must lie between 3 and 20, not {classes}")
    values = features.select(*keys(features), valid(column).alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.least(F.lit(classes - 1), F.floor(guarded((F.col("v") - F.col("low")) * classes, F.col("high") - F.col("low")))).cast("int")
    return values.join(F.broadcast(ends)).select(*keys(features), place.alias("interval"))


def class_codes(predictions: DataFrame, column: str = "class_label") -> DataFrame:
    """class_label, code: classes in order, from 1."""
    return predictions.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)))


def classified_raster(px: DataFrame, predictions: DataFrame, column: str = "class_label") -> DataFrame:
    """row, col, code of each pixel: that of its segment's class, 0 for nodata and segments without a class."""
    codes = F.broadcast(class_codes(predictions, column))  # as many rows as classes
    of_segment = predictions.join(codes, column).select(*keys(predictions), "code")
    return px.select(*image(px), "row", "col", "segment_id").join(of_segment, keys(px), "left").select(*image(px), "row", "col", F.coalesce("code", F.lit(0)).alias("code"))


def inspect(features: DataFrame, boxes: DataFrame, x: float, y: float, column: str) -> DataFrame:
    """segment_id, shown: the value of one segment whose box (min_x, min_y, max_x, max_y) holds the point."""
    at = boxes.where((F.col("min_x") <= x) & (F.col("max_x") >= x) & (F.col("min_y") <= y) & (F.col("max_y") >= y))
    rounded = F.when(valid(column).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4g", F.col(column).cast("double")))
    return at.join(features, keys(features)).select(*keys(features), rounded.alias("shown")).orderBy("segment_id").limit(1)

"""Training samples: points and other geometries on the pixel grid, joins with features, and their editing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grid_row_col

Affine = tuple[float, float, float, float, float, float]


def point_samples(points: DataFrame, px: DataFrame, transform: Affine, class_column: str = "class") -> DataFrame:
    """segment_id, class_label from points (x, y, class, sample_ord): the segment of the pixel each one lies in.

    Points outside the image or on nodata have none; of several in a segment the one with the largest sample_ord
    counts. An equi-join on row and column.
    """
    return _point_meetings(points, px, transform, class_column).drop("sample_ord")


def _point_meetings(points: DataFrame, px: DataFrame, transform: Affine, class_column: str) -> DataFrame:
    """As point_samples, with sample_ord."""
    row, col = grid_row_col(F.col("x"), F.col("y"), transform)
    at = points.select(F.col(class_column).cast("string").alias("class_label"), "sample_ord", row.alias("row"), col.alias("col"))
    met = at.join(px.where("segment_id > 0").select("row", "col", "segment_id"), ["row", "col"])
    return _last(met)


def _last(met: DataFrame) -> DataFrame:
    """One row for each segment: of its last sample."""
    last = met.groupBy("segment_id").agg(F.max(F.struct("sample_ord", "class_label")).alias("last"))
    return last.select("segment_id", "last.class_label", "last.sample_ord")


def all_samples(points: DataFrame, boxes: DataFrame, px: DataFrame, transform: Affine, class_column: str = "class") -> DataFrame:
    """segment_id, class_label from points and boxes as one list in the order of sample_ord: the last sample that meets
    a segment counts, whichever kind it is."""
    at = (px, transform, class_column)
    return _last(_box_meetings(boxes, *at).unionByName(_point_meetings(points, *at))).drop("sample_ord")


def box_samples(boxes: DataFrame, px: DataFrame, transform: Affine, class_column: str = "class", cells: int = 64) -> DataFrame:
    """segment_id, class_label from boxes (min_x, min_y, max_x, max_y, class, sample_ord): every segment with a pixel
    in the box, its far edges included, as for points of several samples the last one counts.

    A range join by way of square cells: boxes are exploded to the cells of the image that they touch, pixels have
    one, and the equi-join's rows are then held against the bounds. The cells of a box are cut to the image's.
    """
    return _box_meetings(boxes, px, transform, class_column, cells).drop("sample_ord")


def _box_meetings(boxes: DataFrame, px: DataFrame, transform: Affine, class_column: str, cells: int = 64) -> DataFrame:
    """As box_samples, with sample_ord."""
    corners = [grid_row_col(F.col(x), F.col(y), transform) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    rows, cols = [r for r, _ in corners], [c for _, c in corners]
    own = px.where("segment_id > 0").select("row", "col", "segment_id")
    size = own.agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    at = boxes.select(
        F.col(class_column).cast("string").alias("class_label"), "sample_ord",
        F.least(*rows).alias("r0"), F.greatest(*rows).alias("r1"), F.least(*cols).alias("c0"), F.greatest(*cols).alias("c1"),
    ).join(F.broadcast(size)).where("r1 >= 0 and c1 >= 0 and r0 <= _rows and c0 <= _cols")
    cell = lambda low, high, most: F.sequence(F.floor(F.greatest(F.col(low), F.lit(0)) / cells), F.floor(F.least(F.col(high), F.col(most)) / cells))
    at = at.withColumn("cell_r", F.explode(cell("r0", "r1", "_rows"))).withColumn("cell_c", F.explode(cell("c0", "c1", "_cols")))
    dealt = own.withColumns({"cell_r": F.floor(F.col("row") / cells), "cell_c": F.floor(F.col("col") / cells)})
    return _last(dealt.join(at, ["cell_r", "cell_c"]).where("row between r0 and r1 and col between c0 and c1"))


def polygon_samples(polygons: DataFrame, px: DataFrame, transform: Affine, class_column: str = "class") -> DataFrame:
    """As box_samples for polygons (ring: array<struct<x, y>>), but only pixels whose centre the ring holds count."""
    a, b, c, d, e, f = map(float, transform)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = polygons.select(F.col(class_column).cast("string").alias("class_label"), "sample_ord", "ring", F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))
    x, y = F.lit(a) * (F.col("col") + 0.5) + F.lit(b) * (F.col("row") + 0.5) + c, F.lit(d) * (F.col("col") + 0.5) + F.lit(e) * (F.col("row") + 0.5) + f
    inner = px.where("segment_id > 0").select("row", "col", "segment_id", x.alias("x"), y.alias("y"))
    # crossings of the ray to the right, edge by edge
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", (i + 1) % n).alias("q")))
    crosses = lambda s: ((s["p"]["y"] > F.col("y")) != (s["q"]["y"] > F.col("y"))) & (F.col("x") < F.try_divide((s["q"]["x"] - s["p"]["x"]) * (F.col("y") - s["p"]["y"]), s["q"]["y"] - s["p"]["y"]) + s["p"]["x"])
    crossings = F.size(F.filter(edges, lambda s: F.coalesce(crosses(s), F.lit(False))))
    cells = 64.0 * max(abs(a), abs(e))
    reach = lambda low, high: F.sequence(F.floor(F.col(low) / cells), F.floor(F.col(high) / cells))
    dealt = boxes.withColumn("cx", F.explode(reach("min_x", "max_x"))).withColumn("cy", F.explode(reach("min_y", "max_y")))
    met = inner.withColumns({"cx": F.floor(F.col("x") / cells), "cy": F.floor(F.col("y") / cells)}).join(dealt, ["cx", "cy"])
    return met.where("x between min_x and max_x and y between min_y and max_y").where(crossings % 2 == 1).groupBy("segment_id").agg(F.max_by("class_label", "sample_ord").alias("class_label"))


def segment_at(px: DataFrame, x: float, y: float, transform: Affine) -> DataFrame:
    """segment_id of the pixel at a map coordinate; no row outside the image or on nodata."""
    row, col = grid_row_col(F.lit(float(x)), F.lit(float(y)), transform)
    return px.where((F.col("row") == row) & (F.col("col") == col) & (F.col("segment_id") > 0)).select("segment_id").limit(1)


def with_labels(features: DataFrame, samples: DataFrame) -> DataFrame:
    """Features of the segments that have a label, with it."""
    return features.join(samples.select("segment_id", "class_label"), "segment_id")


def upserted(samples: DataFrame, new: DataFrame) -> DataFrame:
    """samples with the rows of new added or put in place of those of the same segment."""
    return samples.join(new.select("segment_id"), "segment_id", "left_anti").unionByName(new)


def removed(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return samples.join(ids.select("segment_id"), "segment_id", "left_anti")


def renamed_class(samples: DataFrame, old: str, new: str) -> DataFrame:
    return samples.withColumn("class_label", F.when(F.col("class_label") == old, F.lit(new)).otherwise(F.col("class_label")))


def without_class(samples: DataFrame, label: str) -> DataFrame:
    return samples.where(~F.col("class_label").eqNullSafe(F.lit(label)))

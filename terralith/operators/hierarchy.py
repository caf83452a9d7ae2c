"""Segmentations of several scales: parents by majority, and features across two levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import image


def parent_map(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """segment_id, parent_id: the coarse segment with most of a fine one's pixels, the least of several.

    fine, coarse: pixel relations of the same image. Fine segments that only meet nodata have no row. The overlaps
    are counted before the choice, which is a maximum and not a sort.
    """
    by = image(fine)
    met = fine.where("segment_id > 0").join(coarse.where("segment_id > 0").select(*by, "row", "col", F.col("segment_id").alias("parent_id")), [*by, "row", "col"])
    counts = met.groupBy(*by, "segment_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", (-F.col("parent_id")).alias("minus")))
    return counts.groupBy(*by, "segment_id").agg((-most["minus"]).cast("int").alias("parent_id"))


def cross_scale_features(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """segment_id, parent_id, area_ratio (fine pixels by all of the parent's) and n_siblings (itself included)."""
    by = image(fine)
    parents = parent_map(fine, coarse)
    size = lambda px, key, name: px.where("segment_id > 0").groupBy(*by, F.col("segment_id").alias(key)).agg(F.count(F.lit(1)).alias(name))
    children = parents.groupBy(*by, "parent_id").agg(F.count(F.lit(1)).alias("n_siblings"))
    out = parents.join(size(fine, "segment_id", "_own"), [*by, "segment_id"]).join(size(coarse, "parent_id", "_all"), [*by, "parent_id"]).join(children, [*by, "parent_id"])
    return out.select(*by, "segment_id", "parent_id", (F.col("_own") / F.col("_all")).alias("area_ratio"), "n_siblings")


@dataclass
class Level:
    """One segmentation: its scale, labels as a pixel relation, number of segments and parameters."""

    scale: float
    labels: DataFrame
    n_segments: int
    params: dict = field(default_factory=dict)


@dataclass
class Hierarchy:
    """Levels from finest to coarsest."""

    levels: list[Level]

    def __post_init__(self) -> None:
        self.levels = sorted(self.levels, key=lambda x: -x.n_segments)

    @property
    def n_levels(self) -> int:
        return len(self.levels)

    @property
    def finest(self) -> Level:
        return self.levels[0]

    @property
    def coarsest(self) -> Level:
        return self.levels[-1]

    def parent_map(self, fine: int = 0, coarse: int = 1) -> DataFrame:
        return parent_map(self.levels[fine].labels, self.levels[coarse].labels)

    def cross_scale_features(self, fine: int = 0, coarse: int = 1) -> DataFrame:
        return cross_scale_features(self.levels[fine].labels, self.levels[coarse].labels)


def log_spaced(low: float, high: float, n: int) -> list[int]:
    """n whole numbers from low to high at equal ratios, each once."""
    if n < 2:
        return [int(round(low))]
    return list(dict.fromkeys(int(round(low * (high / low) ** (k / (n - 1)))) for k in range(n)))


def tile_label_offsets(tiles: DataFrame) -> DataFrame:
    """tiles (tile_seq, max_label, image_id if any) with label_offset: the sum of the labels of the tiles before."""
    by = image(tiles)
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("tile_seq").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("label_offset", F.coalesce(F.sum("max_label").over(before), F.lit(0)))

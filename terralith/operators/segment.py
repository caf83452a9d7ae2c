"""Segmentation of pixel relations: numpy kernels for a tile at a time, stitched by joins and running sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .hierarchy import Hierarchy, Level, tile_label_offsets
from .labels import checkpointed, count_segments, image
from .spectral import band_columns

#: name: (default, JSON type, meaning) of each method's parameters.
SCHEMA: dict[str, dict[str, tuple]] = {
    "slic": {"n_segments": (500, "integer", "Segments wanted"), "compactness": (10.0, "number", "Weight of place against colour"), "sigma": (0.0, "number", "Smoothing"), "min_size_factor": (0.5, "number", "Least size, as a share of the mean one"), "enforce_connectivity": (True, "boolean", "One piece for each segment")},
    "felzenszwalb": {"scale": (100.0, "number", "Larger for larger segments"), "sigma": (0.8, "number", "Smoothing"), "min_size": (50, "integer", "Least pixels of a segment")},
    "shepherd": {"num_clusters": (60, "integer", "Classes of the k-means"), "min_n_pxls": (None, "integer", "Least pixels of a segment"), "dist_thres": ("auto", "mixed", "Furthest colour that a small segment goes to"), "sampling": (100, "integer", "Percentage of pixels that the centres are found on"), "min_size": (None, "integer", "Another name of min_n_pxls")},
    "watershed": {"markers": (500, "integer", "Most segments"), "compactness": (0.0, "number", "Weight of the distance to the marker"), "min_distance": (10, "integer", "Pixels between markers")},
    "sam": {"model_type": ("vit_h", "string", "Model"), "points_per_side": (32, "integer", "Prompts in a row"), "pred_iou_thresh": (0.88, "number", "Least predicted overlap"), "stability_score_thresh": (0.95, "number", "Least stability"), "min_mask_region_area": (100, "integer", "Least pixels of a mask"), "device": (None, "string", "Device")},
}
#: Which parameter a method's scale is.
SCALES = {"slic": "n_segments", "felzenszwalb": "scale", "watershed": "markers"}
DEFAULT_SCALES = {"slic": [1000, 500, 100], "felzenszwalb": [50, 100, 500], "watershed": [1000, 500, 100]}


def list_methods() -> list[str]:
    return list(SCHEMA)


@dataclass
class Segmenter:
    method: str
    params: dict

    def get_params(self) -> dict:
        return dict(self.params)

    def get_param_schema(self) -> dict:
        return {"type": "object", "properties": {k: {"type": t, "default": d, "description": s} for k, (d, t, s) in SCHEMA[self.method].items()}}

    def kernel(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Labels of an image, given which pixels are valid; only shepherd leaves the others out of its segments."""
        params = dict(self.params)
        if self.method == "shepherd":
            params["min_n_pxls"] = params.pop("min_size") or params["min_n_pxls"] or 100
            return lambda img, valid: kernels.shepherd(img, **params, valid=valid)
        return lambda img, valid, f=getattr(kernels, self.method): f(img, **params)

    def segment(self, px: DataFrame, nodata_mask: Column | None = None) -> DataFrame:
        """px with segment_id from 1 on, 0 where the mask holds. Each image is one group: for images beyond what a
        task holds, segment_tiled cuts them first."""
        bands, by = band_columns(px), image(px)
        run = self.kernel()
        masked = px.withColumn("_mask", F.lit(False) if nodata_mask is None else F.coalesce(nodata_mask, F.lit(False)))
        names = [*by, "row", "col", *bands]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in px.schema if f.name in names) + ", segment_id int"
        order = [f.name for f in px.schema if f.name in names]

        def labelled(table: pa.Table) -> pa.Table:
            # columns one at a time: a whole image in pandas, and its copy, would take more memory than its labels do
            labels, _ = _labels(_Columns(table), bands, run)
            return table.select(order).append_column("segment_id", pa.array(labels.astype("int32", copy=False)))

        # one group for an image without a name
        rows = masked.select(*order, "_mask", F.lit(0).alias("_all"))
        return (_spread(rows, by) if by else rows).groupBy(*(by or ["_all"])).applyInArrow(labelled, schema)


def _spread(px: DataFrame, keys: list[str]) -> DataFrame:
    """px dealt out by keys to a set number of tasks. Kernels take far longer than the bytes of their pixels suggest,
    so their groups must not be put together by size, as adaptive execution would."""
    spark = px.sparkSession
    return px.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


class _Columns:
    """Columns of an Arrow table as pandas has them, made when asked for."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table

    def __getitem__(self, name: str) -> pd.Series:
        return self.table[name].to_pandas()


def _labels(pdf: pd.DataFrame | _Columns, bands: list[str], run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
    """The label of each row of pdf, 0 where _mask holds, and the largest one. Places without a row are filled with the
    bands' means, and not valid."""
    r, c = pdf["row"].to_numpy() - pdf["row"].min(), pdf["col"].to_numpy() - pdf["col"].min()
    img = np.empty((len(bands), int(r.max()) + 1, int(c.max()) + 1))
    for k, b in enumerate(bands):
        values = np.nan_to_num(pdf[b].to_numpy(float, na_value=np.nan))
        img[k] = values.mean()
        img[k, r, c] = values
    valid = np.zeros(img.shape[1:], bool)
    valid[r, c] = ~pdf["_mask"].to_numpy(bool)
    found = run(img, valid)
    del img
    labels = np.where(valid, found, 0)[r, c]
    return labels, int(labels.max())


def create(method: str, **params) -> Segmenter:
    """A segmenter by name, in any case. ValueError for names and parameters that there aren't."""
    name = method.lower()
    if name not in SCHEMA:
        raise ValueError(f"Unknown segmentation method: {method!r}. Available: {', '.join(SCHEMA)}")
    if unknown := sorted(set(params) - set(SCHEMA[name])):
        raise ValueError(f"Unknown parameter of {name}: {unknown[0]!r}")
    if name == "sam":
        raise ImportError("The sam method needs a segment-anything model, which isn't part of this package; see overlaid_masks for its masks")
    return Segmenter(name, {k: v[0] for k, v in SCHEMA[name].items()} | params)


def segment(px: DataFrame, method: str = "slic", nodata_mask: Column | None = None, bands: list[int] | None = None, progress: Callable[[float], None] | None = None, **params) -> DataFrame:
    """px with segment_id; bands: those that the method sees. progress is told when the plan stands."""
    chosen = px if bands is None else px.select(*image(px), "row", "col", *(f"b{i}" for i in bands), *([] if nodata_mask is None else [nodata_mask.alias("_nodata")]))
    if progress:
        progress(0.0)
    labels = create(method, **params).segment(chosen, nodata_mask if bands is None or nodata_mask is None else F.col("_nodata"))
    out = labels if bands is None else px.join(labels.select(*image(px), "row", "col", "segment_id"), [*image(px), "row", "col"])
    if progress:
        progress(100.0)
    return out


def tile_windows(px: DataFrame, tile_size: int = 1024, overlap: int = 0) -> DataFrame:
    """px with a row for each tile that holds the pixel: tile_row, tile_col (from 0), row_off and col_off. Tiles start
    every tile_size - overlap pixels, as long as that is inside the image."""
    step = tile_size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than tile_size")
    first = lambda x: F.greatest(F.lit(0), F.floor((F.col(x) - tile_size) / step) + 1)
    tiles = lambda x: F.explode(F.sequence(first(x).cast("int"), F.floor(F.col(x) / step).cast("int")))
    out = px.withColumn("tile_row", tiles("row")).withColumn("tile_col", tiles("col"))
    return out.withColumns({"row_off": F.col("tile_row") * step, "col_off": F.col("tile_col") * step})


def tile_sequence(tiled: DataFrame) -> Column:
    """Orders the tiles of an image row by row."""
    return F.col("tile_row").cast("bigint") * F.lit(1 << 31) + F.col("tile_col")


def stitched(tiled: DataFrame, tile_size: int, overlap: int) -> DataFrame:
    """row, col, segment_id from labelled tiles (tile_row, tile_col, row_off, col_off, row, col, label, max_label).

    Each tile's labels go on from the tiles before. A tile gives the pixels of its core, which is the tile without
    half the overlap on the sides that lie inside the image; where cores meet, the later tile counts.
    """
    by, half = image(tiled), overlap // 2
    seq = tile_sequence(tiled)
    of_tile = tiled.groupBy(*by, "tile_row", "tile_col").agg(F.max("max_label").alias("max_label"), F.max("row").alias("_rows"), F.max("col").alias("_cols")).withColumn("tile_seq", seq)
    whole = Window.partitionBy(*by or [F.lit(0)])
    ends = {c: F.max(c).over(whole) for c in ("_rows", "_cols")}
    offsets = tile_label_offsets(of_tile).withColumns(ends).select(*by, "tile_row", "tile_col", "label_offset", "_rows", "_cols")
    joined = tiled.join(offsets, [*by, "tile_row", "tile_col"])  # a row for each tile

    def inside(x: str, off: str, last: str) -> Column:
        low = F.when(F.col(off) > 0, F.col(off) + half).otherwise(0)
        high = F.when(F.col(off) + tile_size <= F.col(last), F.col(off) + tile_size - half).otherwise(F.col(last) + 1)
        return (F.col(x) >= low) & (F.col(x) < high)

    core = joined.where(inside("row", "row_off", "_rows") & inside("col", "col_off", "_cols"))
    value = F.when(F.col("label") > 0, F.col("label") + F.col("label_offset")).otherwise(0).cast("int")
    return core.groupBy(*by, "row", "col").agg(F.max_by(value, seq).alias("segment_id"))


def segment_tiled(px: DataFrame, method: str = "slic", tile_size: int = 2048, overlap: int = 128, nodata_mask: Column | None = None, **params) -> DataFrame:
    """px with segment_id, 0 where the mask holds, found tile by tile: each tile is a group of its own, so an image of
    any size is spread. Segments end at the seams of the cores. The tiles' labels are written to the checkpoint folder at
    once, as numbering and stitching both read them."""
    bands, by = band_columns(px), image(px)
    run = create(method, **params).kernel()
    mask = F.lit(False) if nodata_mask is None else F.coalesce(nodata_mask, F.lit(False))
    tiled = tile_windows(px.select(*by, "row", "col", *bands, mask.alias("_mask")), tile_size, overlap)
    types = {f.name: f.dataType.simpleString() for f in tiled.schema}
    names = [*by, "tile_row", "tile_col", "row_off", "col_off", "row", "col"]

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[names].copy()
        labels, most = _labels(pdf, bands, run)
        return out.assign(label=labels.astype("int32"), max_label=np.int64(most))

    tile = [*by, "tile_row", "tile_col"]
    labels = _spread(tiled, tile).groupBy(*tile).applyInPandas(labelled, ", ".join(f"{n} {types[n]}" for n in names) + ", label int, max_label bigint")
    return px.drop("segment_id").join(stitched(checkpointed(labels), tile_size, overlap), [*by, "row", "col"])


def segment_multiscale(px: DataFrame, method: str = "slic", scales: list[dict | float] | None = None, nodata_mask: Column | None = None) -> Hierarchy:
    """Levels of the scales, which are parameters or values of the method's scale parameter, finest first."""
    name = method.lower()
    if scales is None:
        if name not in DEFAULT_SCALES:
            raise ValueError(f"{method} has no scales of its own; give scales as lists of parameters")
        scales = DEFAULT_SCALES[name]
    levels = []
    for s in scales:
        params = dict(s) if isinstance(s, dict) else {SCALES[name]: s}
        labels = segment(px, name, nodata_mask, **params).persist()
        n = count_segments(labels).agg(F.sum("n_segments")).first()[0] or 0
        scale = next((params[k] for k in ("n_segments", "scale", "markers") if k in params), n)
        levels.append(Level(scale, labels, n, params))
    return Hierarchy(levels)


def overlaid_masks(masks: DataFrame, min_area: int = 100) -> DataFrame:
    """row, col, segment_id from masks (mask_id, row, col): masks of at least min_area pixels, smaller ones on top,
    numbered by size, the largest first."""
    sizes = masks.groupBy("mask_id").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= min_area)
    on_top = F.max(F.struct((-F.col("area")).alias("minus"), "mask_id"))["mask_id"]
    top = masks.join(sizes, "mask_id").groupBy("row", "col").agg(on_top.alias("mask_id"))
    order = sizes.select("mask_id", F.row_number().over(Window.orderBy(F.desc("area"), "mask_id")).alias("segment_id"))
    return top.join(order, "mask_id").select("row", "col", "segment_id")

"""Algorithms by name, with their inputs and outputs as files: what a desktop or a scheduler calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.change import change_table
from ..operators.features import extract
from ..operators.hierarchy import log_spaced
from ..operators.segment import SCALES, segment, segment_multiscale
from ..operators.supervised import classify
from ..sources.geotiff import read_labels, read_raster, write_labels
from ..sources.tables import write_table
from .pipeline import Pipeline, batch_summary, batch_table, process_batch


def segment_file(spark: SparkSession, input: str, output: str, method: str = "slic", **params) -> dict:
    px, meta = read_raster(spark, input)
    labels = segment(px.drop("image_id"), method, **params)
    write_labels(labels, output, meta)
    return {"output": output}


def extract_file(spark: SparkSession, input: str, segments: str, output: str, categories: list[str] | None = None, **options) -> dict:
    px, meta = read_raster(spark, input)
    labels, _ = read_labels(spark, segments)
    options.setdefault("pixel_size", abs(meta.transform[0]))
    write_table(extract(px.drop("image_id").join(labels, ["row", "col"]), categories, **options), output)
    return {"output": output}


def classify_file(spark: SparkSession, features: str, output: str, method: str = "kmeans", training: DataFrame | None = None, **params) -> dict:
    """Parameters go to the method that has them."""
    write_table(classify(spark.read.parquet(features), method, training, **params), output)
    return {"output": output}


def batch_files(spark: SparkSession, inputs: list[str], output_dir: str, pipeline: str, progress: Callable[[int, int], None] | None = None) -> dict:
    results = process_batch(spark, inputs, output_dir, Pipeline.load_string(pipeline), progress=progress)
    return batch_summary(batch_table(spark, results)).first().asDict()


def change_files(spark: SparkSession, before: str, after: str, output: str, threshold: float | str = "otsu", normalize: bool = True) -> dict:
    """change_magnitude and changed of each segment."""
    write_table(change_table(spark.read.parquet(before), spark.read.parquet(after), threshold, normalize), output)
    return {"output": output}


def multiscale_files(spark: SparkSession, input: str, output_dir: str, method: str = "slic", low: float = 100, high: float = 1000, levels: int = 3) -> dict:
    """A file of labels for each of several scales at equal ratios, finest first."""
    px, meta = read_raster(spark, input)
    found = segment_multiscale(px.drop("image_id"), method, [{SCALES[method]: s} for s in log_spaced(low, high, levels)])
    paths = []
    for k, level in enumerate(found.levels):
        paths.append(f"{output_dir.rstrip('/')}/level_{k}.tif")
        write_labels(level.labels, paths[-1], meta)
    return {"outputs": paths, "n_segments": [x.n_segments for x in found.levels]}


ALGORITHMS: dict[str, Callable[..., dict]] = {
    "segment": segment_file,
    "extract_features": extract_file,
    "classify": classify_file,
    "batch": batch_files,
    "change_detection": change_files,
    "multiscale_segment": multiscale_files,
}

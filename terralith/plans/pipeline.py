"""Pipelines of steps: segment, extract, classify; as objects, as JSON, and over many images."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import EXTRACTORS, extract
from ..operators.fuzzy import FuzzyClassifier
from ..operators.labels import count_segments, image
from ..operators.samples import all_samples
from ..operators.segment import SCHEMA, segment, segment_tiled
from ..operators.supervised import ALGORITHMS as SUPERVISED
from ..operators.supervised import classify
from ..operators.unsupervised import ALGORITHMS as UNSUPERVISED
from ..operators.vectorize import vectorize, with_attributes
from ..sources.geotiff import RasterMeta, read_raster, write_labels
from ..sources.tables import read_text, write_features, write_text
from ..sources.vector import read_vector, sample_geometries, write_vector

ORDER = ("segment", "extract", "classify")
VERSION = "1.0"
#: Pixels of the largest image that is segmented by one task; larger ones are cut into tiles.
WHOLE = 1 << 24


@dataclass
class PipelineResult:
    labels: DataFrame | None = None
    features: DataFrame | None = None
    predictions: DataFrame | None = None
    meta: RasterMeta | None = None
    steps: list[dict] = field(default_factory=list)

    def export(self, path: str) -> None:
        """.gpkg and .geojson: polygons with the predictions; .parquet: features with the class. Else ValueError."""
        if path.endswith((".gpkg", ".geojson", ".json")):
            if self.labels is None:
                raise ValueError("There are no labels to export")
            layer = vectorize(self.labels, self.meta.transform if self.meta else (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (self.meta.srid or 0) if self.meta else 0)
            write_vector(layer if self.predictions is None else with_attributes(layer, self.predictions), path)
        elif path.endswith(".parquet"):
            if self.features is None:
                raise ValueError("There are no features to export")
            out = self.features
            if self.predictions is not None:
                label = [c for c in self.predictions.columns if c not in ("image_id", "segment_id")][0]
                out = out.join(self.predictions.withColumnRenamed(label, "class_label"), [*image(out), "segment_id"], "left")
            write_features(out, path)
        else:
            raise ValueError(f"Unknown export format: {path}")

    def provenance(self) -> dict:
        """The steps with their durations (of building the plan and of what a model's fit computes) and their sum."""
        return {"steps": [{**s, "duration_s": round(s["duration_s"], 3)} for s in self.steps], "total_duration_s": round(sum(s["duration_s"] for s in self.steps), 3)}


class Pipeline:
    """steps: (type, method or categories, parameters); segment before extract before classify, each as often as
    wanted."""

    def __init__(self, steps: list[tuple]) -> None:
        self.steps = [(s[0], s[1], dict(s[2]) if len(s) > 2 and s[2] else {}) for s in steps]
        at = 0
        for kind, what, _ in self.steps:
            if kind not in ORDER:
                raise ValueError(f"Unknown step type: {kind!r}. Available: {', '.join(ORDER)}")
            if ORDER.index(kind) < at:
                raise ValueError(f"Step {kind!r} can't follow {ORDER[at]!r}")
            at = ORDER.index(kind)
            if kind == "segment" and str(what).lower() not in SCHEMA:
                raise ValueError(f"Unknown segmentation method: {what!r}")
            if kind == "extract" and what is not None and (unknown := [c for c in what if c.lower() not in EXTRACTORS]):
                raise ValueError(f"Unknown feature category: {unknown[0]!r}")
            if kind == "classify" and what is not None and what not in (*SUPERVISED, *UNSUPERVISED, "fuzzy"):
                raise ValueError(f"Unknown classification method: {what!r}")

    def run(self, px: DataFrame | None = None, meta: RasterMeta | None = None, training: DataFrame | str | None = None, input_path: str | None = None, class_column: str = "class", spark: SparkSession | None = None) -> PipelineResult:
        """On a pixel relation or a file. training: segment_id and class_label, or the path of a layer of samples."""
        result = PipelineResult(meta=meta)
        spark = spark or (px.sparkSession if px is not None else SparkSession.getActiveSession())
        began = time.perf_counter()

        def done(kind: str, **more) -> None:
            nonlocal began
            now = time.perf_counter()
            result.steps.append({"step": kind, "duration_s": now - began} | more)
            began = now

        if px is None:
            if input_path is None:
                raise ValueError("Either px or input_path is needed")
            px, result.meta = read_raster(spark, input_path)
            px = px.drop("image_id")
            done("load", path=input_path, width=result.meta.width, height=result.meta.height, bands=result.meta.count)
        for kind, what, params in self.steps:
            if kind == "segment":
                nodata = result.meta.nodata if result.meta else None
                mask = None
                if nodata is not None:
                    bands = [c for c in px.columns if c[0] == "b" and c[1:].isdigit()]
                    mask = F.lit(False)
                    for c in bands:
                        mask = mask | (F.col(c) == nodata)
                # what a task can't hold is cut into tiles
                whole = result.meta is not None and result.meta.width * result.meta.height <= WHOLE or result.meta is None and px.count() <= WHOLE
                found = segment(px.drop("segment_id"), what or "slic", mask, **params) if whole else segment_tiled(px.drop("segment_id"), what or "slic", nodata_mask=mask, **params)
                result.labels = found.persist()
                n = count_segments(result.labels).agg(F.sum("n_segments")).first()[0] or 0
                done("segment", method=what, params=params, n_segments=n)
            elif kind == "extract":
                labels = result.labels if result.labels is not None else px if "segment_id" in px.columns else None
                if labels is None:
                    raise ValueError("extract needs a segment step or labels")
                result.features = extract(labels, what, **params).persist()
                done("extract", categories=what, n_features=len(result.features.columns) - 1)
            else:
                if result.features is None:
                    raise ValueError("classify needs an extract step")
                given = training
                if isinstance(given, str):
                    points, boxes = sample_geometries(read_vector(spark, given), class_column, result.meta.srid if result.meta else None)
                    given = all_samples(points, boxes, result.labels, result.meta.transform if result.meta else (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), class_column)
                result.predictions = classify(result.features, what or "kmeans", given, **params)
                done("classify", method=what or "kmeans", params={k: v for k, v in params.items() if k != "rules"})
        return result

    def to_json(self) -> str:
        def shown(kind: str, params: dict) -> dict:
            return params | FuzzyClassifier.from_params(params).get_params() if "rules" in params else params

        return json.dumps({"version": VERSION, "steps": [{"type": k, "method": w, "params": shown(k, p)} for k, w, p in self.steps]})

    @classmethod
    def load_string(cls, text: str) -> Pipeline:
        return cls([(s["type"], s.get("method"), s.get("params") or {}) for s in json.loads(text)["steps"]])

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        write_text(spark or SparkSession.getActiveSession(), path, self.to_json())

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Pipeline:
        return cls.load_string(read_text(spark or SparkSession.getActiveSession(), path))


@dataclass
class BatchResult:
    input_path: str
    labels_path: str | None = None
    features: DataFrame | None = None
    predictions: DataFrame | None = None
    n_segments: int = 0
    duration_s: float = 0.0
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def process_batch(spark: SparkSession, paths: list[str], output_dir: str, pipeline: Pipeline, training_labels: DataFrame | None = None, progress: Callable[[int, int], None] | None = None) -> list[BatchResult]:
    """One result for each path, in their order; a failing image gives its error and doesn't stop the others.

    Every image runs as Spark jobs of its own, whose tasks take the whole cluster; for many small images at once,
    segment the relation of read_raster(*paths), whose operators work on each image_id by itself.
    """
    out = []
    for k, path in enumerate(paths):
        began, result = time.perf_counter(), BatchResult(path)
        try:
            found = pipeline.run(input_path=path, training=training_labels, spark=spark)
            if found.labels is not None:
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                result.labels_path = f"{output_dir.rstrip('/')}/{stem}_labels.tif"
                write_labels(found.labels, result.labels_path, found.meta)
                result.n_segments = found.labels.agg(F.max("segment_id")).first()[0] or 0
            result.features, result.predictions = found.features, found.predictions
        except Exception as e:  # noqa: BLE001  what went wrong with an image is its result
            result.error = f"{type(e).__name__}: {e}"
        result.duration_s = time.perf_counter() - began
        out.append(result)
        if progress:
            progress(k + 1, len(paths))
    return out


def batch_table(spark: SparkSession, results: list[BatchResult]) -> DataFrame:
    rows = [(r.input_path, r.labels_path, int(r.n_segments), float(r.duration_s), r.error) for r in results]
    return spark.createDataFrame(rows, "input_path string, labels_path string, n_segments bigint, duration_s double, error string")


def batch_summary(table: DataFrame) -> DataFrame:
    """One row: total, succeeded, failed, total_segments, total_duration_s (to two places), errors by path (null if
    there are none)."""
    ok = F.col("error").isNull()
    sums = table.agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(ok, 1).otherwise(0)).alias("succeeded"), F.sum(F.when(ok, 0).otherwise(1)).alias("failed"),
        F.coalesce(F.sum("n_segments"), F.lit(0)).alias("total_segments"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 2).alias("total_duration_s"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~ok, F.struct("input_path", "error"))))).alias("_e"),
    )
    zero = F.lit(0).cast("bigint")
    return sums.select("total", F.coalesce("succeeded", zero).alias("succeeded"), F.coalesce("failed", zero).alias("failed"), "total_segments", "total_duration_s", F.when(F.size("_e") > 0, F.col("_e")).alias("errors"))

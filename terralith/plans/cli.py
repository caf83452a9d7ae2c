"""Command line: segment, extract, classify, info, export. Each command reads files and writes files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.features import extract
from ..operators.samples import all_samples
from ..operators.segment import segment, segment_tiled
from ..operators.supervised import ALGORITHMS as SUPERVISED
from ..operators.supervised import classify
from ..operators.vectorize import vectorize, with_attributes
from ..sources.geotiff import read_raster, write_labels
from ..sources.tables import write_table
from ..sources.vector import geopackage_layers, read_vector, sample_geometries, write_vector

#: Overlap of tiles on the command line.
OVERLAP = 128


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="terralith")
    sub = out.add_subparsers(dest="command", required=True)
    s = sub.add_parser("segment")
    s.add_argument("input")
    s.add_argument("-o", "--output", required=True)
    s.add_argument("--method", default="slic", choices=["slic", "felzenszwalb", "shepherd", "watershed"])
    for name, kind, default in (("n-segments", int, 500), ("compactness", float, 10.0), ("scale", float, 100.0), ("min-size", int, 50), ("num-clusters", int, 60), ("dist-thres", float, 100.0), ("sampling", int, 100), ("markers", int, 500), ("min-distance", int, 10), ("sigma", float, None), ("tile-size", int, 2048)):
        s.add_argument(f"--{name}", type=kind, default=default)
    s.add_argument("--tiled", action="store_true")
    e = sub.add_parser("extract")
    e.add_argument("input")
    e.add_argument("segments")
    e.add_argument("-o", "--output", required=True)
    for name, default in (("spectral", True), ("geometry", True), ("texture", False), ("context", False)):
        e.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)
    e.add_argument("--band-names")
    c = sub.add_parser("classify")
    c.add_argument("features")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--method", default="random_forest", choices=["random_forest", "svm", "gradient_boosting", "kmeans", "gmm", "dbscan"])
    c.add_argument("--training")
    c.add_argument("--segments")
    c.add_argument("--n-clusters", type=int, default=8)
    c.add_argument("--n-estimators", type=int, default=100)
    i = sub.add_parser("info")
    i.add_argument("file")
    x = sub.add_parser("export")
    x.add_argument("segments")
    x.add_argument("-o", "--output", required=True)
    x.add_argument("--features")
    x.add_argument("--classification")
    return out


def method_params(a: argparse.Namespace) -> dict:
    """What each method takes of the options."""
    some = {
        "slic": {"n_segments": a.n_segments, "compactness": a.compactness},
        "felzenszwalb": {"scale": a.scale, "min_size": a.min_size},
        "shepherd": {"num_clusters": a.num_clusters, "min_n_pxls": a.min_size, "dist_thres": a.dist_thres, "sampling": a.sampling},
        "watershed": {"markers": a.markers, "min_distance": a.min_distance, "compactness": a.compactness if a.compactness != 10.0 else 0.0},
    }[a.method]
    return some | ({"sigma": a.sigma} if a.sigma is not None and a.method in ("slic", "felzenszwalb") else {})


def _labelled(spark: SparkSession, path: str):
    labels, meta = read_raster(spark, path)
    return labels.select("row", "col", F.col("b0").cast("int").alias("segment_id")), meta


def _layer(spark: SparkSession, path: str):
    labels, meta = _labelled(spark, path)
    return vectorize(labels, meta.transform, meta.srid or 0), meta


def run_segment(spark: SparkSession, a: argparse.Namespace) -> int:
    px, meta = read_raster(spark, a.input)
    px, params = px.drop("image_id"), method_params(a)
    out = segment_tiled(px, a.method, a.tile_size, OVERLAP, **params) if a.tiled else segment(px, a.method, **params)
    out = out.persist()
    write_labels(out, a.output, meta)
    print(f"Segments: {out.where('segment_id > 0').select('segment_id').distinct().count()}")
    return 0


def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    px, meta = read_raster(spark, a.input)
    labels, _ = _labelled(spark, a.segments)
    chosen = [c for c in ("spectral", "geometry", "texture", "context") if getattr(a, c)]
    options: dict = {"pixel_size": abs(meta.transform[0])} if a.geometry else {}
    if a.band_names:
        options["band_names"] = {n.strip(): k for k, n in enumerate(a.band_names.split(","))}
    features = extract(px.drop("image_id").join(labels, ["row", "col"]), chosen, **options)
    write_table(features, a.output)
    print(f"Features: {len(features.columns) - 1}")
    return 0


def run_classify(spark: SparkSession, a: argparse.Namespace) -> int:
    features = spark.read.parquet(a.features)
    training = None
    if a.method in SUPERVISED:
        if not a.training or not a.segments:
            print("Supervised methods need --training and --segments", file=sys.stderr)
            return 1
        labels, meta = _labelled(spark, a.segments)
        points, boxes = sample_geometries(read_vector(spark, a.training), srid=meta.srid)
        training = all_samples(points, boxes, labels, meta.transform)
    params = {"n_clusters": a.n_clusters} if a.method == "kmeans" else {"n_estimators": a.n_estimators} if a.method in ("random_forest", "gradient_boosting") else {}
    found = classify(features, a.method, training, **params)
    if a.output.endswith(".gpkg"):
        if not a.segments:
            print("A vector layer needs --segments", file=sys.stderr)
            return 1
        layer, _ = _layer(spark, a.segments)
        write_vector(with_attributes(layer, found), a.output)
    else:
        write_table(features.join(found, "segment_id", "left") if a.output.endswith(".csv") else found, a.output)
    return 0


def run_info(spark: SparkSession, a: argparse.Namespace) -> int:
    path = a.file
    if path.endswith((".tif", ".tiff")):
        px, meta = read_raster(spark, path)
        print(f"Size: {meta.width} x {meta.height}\nBands: {meta.count}\nType: {meta.dtype}\nCRS: {meta.srid}\nResolution: {abs(meta.transform[0])} x {abs(meta.transform[4])}\nBounds: {meta.bounds}")
        if meta.dtype.startswith(("int", "uint")):
            print(f"Segments: {px.where('b0 > 0').select('b0').distinct().count()}")
    elif path.endswith(".parquet"):
        table = spark.read.parquet(path)
        print(f"Rows: {table.count()}\nColumns: {len(table.columns)}\nNames: {', '.join(table.columns[:20])}")
    elif path.endswith(".gpkg"):
        layer = read_vector(spark, path)
        print(f"Rows: {layer.count()}\nColumns: {len(layer.columns)}\nCRS: {geopackage_layers(path)[0][2]}")
    else:
        print(f"Unknown format: {path}", file=sys.stderr)
        return 1
    return 0


def run_export(spark: SparkSession, a: argparse.Namespace) -> int:
    layer, meta = _layer(spark, a.segments)
    if a.features:
        layer = with_attributes(layer, spark.read.parquet(a.features))
    if a.classification:
        found = spark.read.parquet(a.classification)
        layer = with_attributes(layer, found.select("segment_id", "class_label") if a.features and "class_label" in found.columns else found)
    write_vector(layer, a.output)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("terralith").getOrCreate()
    return {"segment": run_segment, "extract": run_extract, "classify": run_classify, "info": run_info, "export": run_export}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())

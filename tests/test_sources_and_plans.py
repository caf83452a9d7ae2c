"""Files, pipelines, batches, the command line, streams, and the package's shape."""

import json
import re
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.params import checked, coerced
from terralith.operators import segment
from terralith.operators.fuzzy import FuzzyRule
from terralith.plans.algorithms import ALGORITHMS
from terralith.plans.cli import main
from terralith.plans.pipeline import Pipeline, batch_summary, batch_table, process_batch
from terralith.plans.session import Run, Session
from terralith.sources import geotiff, vector
from terralith.streaming.tiles import for_each_batch, running_spectral, tile_stream

META = geotiff.RasterMeta(30, 24, 4, "float32", (10.0, 0.0, 500000.0, 0.0, -10.0, 5000000.0), 32633, None)


def quadrant_image(seed=42, h=24, w=30):
    rng = np.random.RandomState(seed)
    image = np.zeros((4, h, w), "f4")
    for r, c, means in ((0, 0, (0.15, 0.2, 0.1, 0.55)), (0, 1, (0.4, 0.38, 0.35, 0.42)), (1, 0, (0.05, 0.08, 0.12, 0.03)), (1, 1, (0.3, 0.25, 0.2, 0.28))):
        for b, m in enumerate(means):
            image[b, r * h // 2 : (r + 1) * h // 2, c * w // 2 : (c + 1) * w // 2] = rng.normal(m, 0.01, (h // 2, w // 2))
    return np.clip(image, 0, 1)


@pytest.fixture(scope="module")
def raster(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raster") / "scene.tif")
    geotiff.write_raster(path, quadrant_image(), META)
    return path


@pytest.mark.parametrize("dtype", ["uint8", "int32", "float32", "float64"])
@pytest.mark.parametrize("options", [{}, {"tiled": False}, {"compress": None, "blocksize": 16}])
def test_raster_round_trip(tmp_path, dtype, options):
    data = (np.arange(2 * 37 * 53).reshape(2, 37, 53) % 200).astype(dtype)
    meta = geotiff.RasterMeta(53, 37, 2, dtype, (2.0, 0.0, 7.0, 0.0, -3.0, 9.0), 4326, -1.0)
    path = str(tmp_path / "x.tif")
    geotiff.write_raster(path, data, meta, **options)
    got, found = geotiff.read_array(path)
    assert (got == data).all() and got.dtype == data.dtype and found == meta
    assert found.bounds == (7.0, 9.0 - 111, 113.0, 9.0)
    part = geotiff.TiffFile(path).read(10, 20, 15, 40)
    assert (part == data[:, 10:25, 20:53]).all()


def test_lzw():
    # codes of 9 bits: start anew, then a, ab and so on
    codes = [256, ord("a"), ord("b"), 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert geotiff._lzw(data) == b"ab" + b"ab" + b"aba"


def test_raster_warnings_and_windows(tmp_path, raster):
    with pytest.warns(UserWarning):
        geotiff.write_raster(str(tmp_path / "y.tif"), np.zeros((3, 4), "u1"))
    tiles = list(geotiff.read_windows(raster, 16, 4))
    assert [at for _, _, at in tiles] == [(0, 0), (0, 12), (0, 24), (12, 0), (12, 12), (12, 24)]
    assert tiles[1][1].transform == (10.0, 0.0, 500120.0, 0.0, -10.0, 5000000.0) and tiles[-1][0].shape == (4, 12, 6)
    with pytest.raises(ValueError):
        list(geotiff.windows(10, 10, 4, 4))


def test_raster_source(spark, raster):
    px, meta = geotiff.read_raster(spark, raster, tile_size=10)
    assert px.columns == ["image_id", "row", "col", "b0", "b1", "b2", "b3"] and px.count() == 720 and meta.srid == 32633
    image = quadrant_image()
    assert all(abs(r["b3"] - image[3, r["row"], r["col"]]) < 1e-6 for r in px.where("row = 5").collect())


def test_vector_layers(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    rows = [(1, "a", 0.5, vector.polygon_wkb([ring])), (2, None, None, vector.point_wkb(9.0, 8.0)), (3, "c", 2.0, None)]
    layer = spark.createDataFrame(rows, "segment_id int, class_label string, score double, geometry binary")
    vector.write_vector(layer, str(tmp_path / "l.gpkg"), srid=32633)
    got = vector.read_vector(spark, str(tmp_path / "l.gpkg")).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["class_label"], r["score"], r["geometry"]) for r in got] == [(a, b, c, bytearray(g) if g else None) for a, b, c, g in rows]
    assert got[0]["srid"] == 32633 and vector.wkb_coordinates(bytes(got[0]["geometry"])) == ring
    vector.write_vector(layer, str(tmp_path / "l.geojson"))
    assert json.loads((tmp_path / "l.geojson").read_text())["features"][0]["geometry"]["type"] == "Polygon"
    back = vector.read_vector(spark, str(tmp_path / "l.geojson")).orderBy("segment_id").collect()
    assert [bytes(r["geometry"]) if r["geometry"] else None for r in back] == [g for *_, g in rows]
    vector.write_vector(layer, str(tmp_path / "l.parquet"))
    assert vector.read_vector(spark, str(tmp_path / "l.parquet")).count() == 3
    for f in (vector.read_vector, ):
        with pytest.raises(ValueError):
            f(spark, "x.shp")
    points, boxes = vector.sample_geometries(layer.withColumnRenamed("class_label", "class"))
    assert points.count() == 1 and tuple(boxes.first())[:4] == (0.0, 0.0, 4.0, 3.0)
    with pytest.raises(ValueError):
        vector.sample_geometries(layer)


def test_pipeline(spark, raster, tmp_path):
    steps = [("segment", "slic", {"n_segments": 12}), ("extract", ["spectral", "geometry"], {"band_names": {"red": 0, "green": 1, "blue": 2, "nir": 3}}), ("classify", "kmeans", {"n_clusters": 3, "n_init": 1})]
    pipeline = Pipeline(steps)
    again = Pipeline.load_string(pipeline.to_json())
    assert again.steps == pipeline.steps and json.loads(pipeline.to_json())["version"] == "1.0"
    pipeline.save(str(tmp_path / "p.json"))
    assert Pipeline.load(str(tmp_path / "p.json")).steps == pipeline.steps
    result = pipeline.run(input_path=raster, spark=spark)
    n = result.features.count()
    assert n >= 4 and result.predictions.count() == n and "ndvi" in result.features.columns
    told = result.provenance()
    assert [s["step"] for s in told["steps"]] == ["load", "segment", "extract", "classify"] and told["total_duration_s"] > 0 and told["steps"][1]["n_segments"] == n
    result.export(str(tmp_path / "out.gpkg"))
    assert vector.read_vector(spark, str(tmp_path / "out.gpkg")).where("cluster is not null").count() == n
    result.export(str(tmp_path / "out.parquet"))
    assert "class_label" in spark.read.parquet(str(tmp_path / "out.parquet")).columns
    with pytest.raises(ValueError):
        result.export("x.doc")


def test_pipeline_errors(spark):
    for steps in ([("paint", "x", {})], [("classify", "kmeans", {}), ("segment", "slic", {})], [("segment", "magic", {})], [("extract", ["magic"], {})], [("classify", "magic", {})]):
        with pytest.raises(ValueError):
            Pipeline(steps)
    with pytest.raises(ValueError):
        Pipeline([("segment", "slic", {})]).run(spark=spark)
    rules = {"rules": {"a": [FuzzyRule("mean_band_0", 0, 1)]}}
    assert Pipeline.load_string(Pipeline([("classify", "fuzzy", rules)]).to_json()).steps[0][2]["rules"]["a"][0]["high"] == 1


def test_batch(spark, raster, tmp_path):
    told = []
    results = process_batch(spark, [raster, "missing.tif"], str(tmp_path), Pipeline([("segment", "felzenszwalb", {"min_size": 20}), ("extract", ["spectral"], {})]), progress=lambda a, b: told.append((a, b)))
    assert [r.success for r in results] == [True, False] and told == [(1, 2), (2, 2)] and results[0].n_segments >= 4
    labels, meta = geotiff.read_array(results[0].labels_path)
    assert labels.max() == results[0].n_segments and meta.nodata == 0 and results[0].labels_path.endswith("scene_labels.tif")
    s = batch_summary(batch_table(spark, results)).first()
    assert (s["total"], s["succeeded"], s["failed"], s["total_segments"]) == (2, 1, 1, results[0].n_segments) and list(s["errors"]) == ["missing.tif"]
    assert batch_summary(batch_table(spark, results[:1])).first()["errors"] is None


def test_command_line(spark, raster, tmp_path, capsys):
    seg, feat = str(tmp_path / "seg.tif"), str(tmp_path / "feat.parquet")
    assert main(["segment", raster, "-o", seg, "--method", "felzenszwalb", "--min-size", "20"], spark) == 0
    assert main(["extract", raster, seg, "-o", feat, "--band-names", "red, green,blue,nir", "--context"], spark) == 0
    assert {"ndvi", "n_neighbors", "area"} <= set(spark.read.parquet(feat).columns)
    assert main(["classify", feat, "-o", str(tmp_path / "c.parquet"), "--method", "kmeans", "--n-clusters", "2"], spark) == 0
    assert main(["classify", feat, "-o", str(tmp_path / "c.csv"), "--method", "dbscan"], spark) == 0
    assert main(["classify", feat, "-o", str(tmp_path / "c.gpkg"), "--method", "kmeans", "--n-clusters", "2"], spark) == 1
    points = spark.createDataFrame([(vector.point_wkb(500000 + 10 * c + 5, 5000000 - 10 * r - 5), k) for r, c, k in ((5, 7, "a"), (5, 22, "b"), (18, 7, "c"), (18, 22, "d"))], "geometry binary, class string")
    vector.write_vector(points, str(tmp_path / "t.gpkg"), srid=32633)
    assert main(["classify", feat, "-o", str(tmp_path / "r.parquet"), "--training", str(tmp_path / "t.gpkg"), "--segments", seg, "--n-estimators", "5"], spark) == 0
    assert main(["classify", feat, "-o", str(tmp_path / "r2.parquet")], spark) == 1
    assert main(["export", seg, "-o", str(tmp_path / "e.gpkg"), "--features", feat, "--classification", str(tmp_path / "r.parquet")], spark) == 0
    assert {"ndvi", "class_label"} <= set(vector.read_vector(spark, str(tmp_path / "e.gpkg")).columns)
    for f in (raster, seg, feat, str(tmp_path / "e.gpkg")):
        assert main(["info", f], spark) == 0
    assert main(["info", "x.doc"], spark) == 1
    assert "Bands: 4" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    px = spark.range(400).select(F.lit("a").alias("image_id"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), (1 + F.col("id") % 3).cast("int").alias("segment_id"), F.col("id").cast("double").alias("b0"))
    folder = str(tmp_path / "tiles")
    px.repartition(4).write.parquet(folder)
    stream = tile_stream(spark, folder, px.schema, 1)
    query = running_spectral(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["segment_id"]: (r["n"], r["mean_b0"]) for r in spark.table("seen").collect()}
    want = {r["segment_id"]: (r["n"], r["m"]) for r in px.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.avg("b0").alias("m")).collect()}
    assert got == want
    done = for_each_batch(tile_stream(spark, folder, px.schema, 2), lambda b: b.groupBy("segment_id").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 400


def test_algorithms(spark, raster, tmp_path):
    seg, feat = str(tmp_path / "s.tif"), str(tmp_path / "f.parquet")
    ALGORITHMS["segment"](spark, input=raster, output=seg, method="felzenszwalb", min_size=20)
    ALGORITHMS["extract_features"](spark, input=raster, segments=seg, output=feat, categories=["spectral"])
    ALGORITHMS["classify"](spark, features=feat, output=str(tmp_path / "c.parquet"), n_clusters=2, n_init=1)
    ALGORITHMS["change_detection"](spark, before=feat, after=feat, output=str(tmp_path / "d.parquet"))
    assert spark.read.parquet(str(tmp_path / "d.parquet")).where("changed").count() == 0
    levels = ALGORITHMS["multiscale_segment"](spark, input=raster, output_dir=str(tmp_path), low=6, high=24, levels=2)
    assert levels["n_segments"][0] > levels["n_segments"][1] and geotiff.read_array(levels["outputs"][0])[0].max() == levels["n_segments"][0]
    told = ALGORITHMS["batch"](spark, inputs=[raster], output_dir=str(tmp_path), pipeline=Pipeline([("segment", "felzenszwalb", {})]).to_json())
    assert told["succeeded"] == 1
    geotiff.write_raster(str(tmp_path / "none.tif"), np.zeros((4, 4), "i4"), META)
    with pytest.raises(ValueError):
        geotiff.read_labels(spark, str(tmp_path / "none.tif"))


def test_session(spark):
    run = lambda k: Run("slic", {"n_segments": k}, spark.range(k).toDF("segment_id"))
    s = Session()
    assert [s.add(run(k)) for k in (1, 2, 3)] == [0, 1, 2]
    s.features = spark.range(1)
    s.delete(0)
    assert s.active == 1 and s.features is not None and s.runs[s.active].params == {"n_segments": 3}
    s.activate(0)
    assert s.features is None and s.pipeline_steps()[0] == ("segment", "slic", {"n_segments": 2})
    s.delete(0)
    assert s.active == 0 and len(s.runs) == 1
    Pipeline(s.pipeline_steps())
    with pytest.raises(IndexError):
        s.activate(5)


def test_parameters():
    assert [coerced(x) for x in ("", "1, 2", "3", "0.5", "auto", "a,b")] == [None, [1, 2], 3, 0.5, "auto", "a,b"]
    schema = segment.create("slic").get_param_schema()
    assert checked({"n_segments": 9}, schema)["compactness"] == 10.0
    for bad in ({"x": 1}, {"n_segments": "many"}, {"n_segments": True}):
        with pytest.raises(ValueError):
            checked(bad, schema)


def test_nothing_imports_the_text_operators():
    root = Path(__file__).resolve().parent.parent / "terralith"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_samples_in_another_reference_system(spark):
    layer = spark.createDataFrame([(struct.pack("<BIdd", 1, 1, 2.0, 3.0), "a", 4326)], "geometry binary, class string, srid int")
    assert vector.sample_geometries(layer, srid=4326)[0].count() == 1 == vector.sample_geometries(layer)[0].count()
    with pytest.raises(ValueError, match="EPSG:4326"):
        vector.sample_geometries(layer, srid=32632)

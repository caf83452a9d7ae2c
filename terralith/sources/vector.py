"""Vector layers: GeoPackage by the standard library's SQLite, GeoJSON by Spark's JSON reader, WKB throughout."""

from __future__ import annotations

import json
import os
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SQL_TYPES = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "BOOLEAN", T.DoubleType: "REAL", T.FloatType: "REAL"}


def wkb_coordinates(data: bytes) -> list[tuple[float, float]]:
    """All coordinates of a WKB geometry of two dimensions."""

    def walk(at: int) -> int:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            out.append(struct.unpack_from(order + "dd", data, at))
            return at + 16
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        for _ in range(n):
            if kind == 2:
                out.append(struct.unpack_from(order + "dd", data, at))
                at += 16
            elif kind == 3:
                m = struct.unpack_from(order + "I", data, at)[0]
                at += 4
                for _ in range(m):
                    out.append(struct.unpack_from(order + "dd", data, at))
                    at += 16
            else:
                at = walk(at)
        return at

    out: list[tuple[float, float]] = []
    if data:
        walk(0)
    return out


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def from_geojson(geometry: dict) -> bytes:
    kind, c = geometry["type"], geometry.get("coordinates")
    if kind == "Point":
        return point_wkb(*c[:2])
    if kind == "LineString":
        return struct.pack("<BII", 1, 2, len(c)) + b"".join(struct.pack("<dd", *p[:2]) for p in c)
    if kind == "Polygon":
        return polygon_wkb([[tuple(p[:2]) for p in r] for r in c])
    code = {"MultiPoint": (4, "Point"), "MultiLineString": (5, "LineString"), "MultiPolygon": (6, "Polygon")}[kind]
    return struct.pack("<BII", 1, code[0], len(c)) + b"".join(from_geojson({"type": code[1], "coordinates": x}) for x in c)


def to_geojson(data: bytes) -> dict:
    def walk(at: int) -> tuple[dict, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
        at += 5

        def point(at):
            return list(struct.unpack_from(order + "dd", data, at)), at + 16

        def points(at):
            n = struct.unpack_from(order + "I", data, at)[0]
            return [list(struct.unpack_from(order + "dd", data, at + 4 + 16 * i)) for i in range(n)], at + 4 + 16 * n

        if kind == 1:
            c, at = point(at)
            return {"type": "Point", "coordinates": c}, at
        if kind == 2:
            c, at = points(at)
            return {"type": "LineString", "coordinates": c}, at
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        parts = []
        for _ in range(n):
            if kind == 3:
                c, at = points(at)
            else:
                one, at = walk(at)
                c = one["coordinates"]
            parts.append(c)
        return {"type": {3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], "coordinates": parts}, at

    return walk(0)[0]


def geopackage_layers(path: str) -> list[tuple[str, str, int]]:
    """(table, geometry column, srid) of each layer."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The layer's attributes, geometry (WKB) and srid. One process reads the file, as SQLite does."""
    layers = geopackage_layers(path)
    name, column, srid = next((x for x in layers if layer in (None, x[0])), (None, None, None))
    if name is None:
        raise ValueError(f"No layer {layer!r} in {path}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        info = [(c[1], c[2].upper()) for c in db.execute(f'PRAGMA table_info("{name}")') if c[1] not in ("fid", column)]
        rows = db.execute(f'SELECT {"".join(f"""\"{c}\", """ for c, _ in info)}"{column}" FROM "{name}"').fetchall()
    kinds = {"INT": T.LongType(), "BOO": T.LongType(), "REA": T.DoubleType(), "DOU": T.DoubleType(), "FLO": T.DoubleType(), "MED": T.LongType(), "TIN": T.LongType(), "SMA": T.LongType()}
    schema = T.StructType([*(T.StructField(c, kinds.get(t[:3], T.StringType())) for c, t in info), T.StructField("geometry", T.BinaryType())])
    envelope = (0, 32, 48, 48, 64)
    plain = lambda blob: bytes(blob[8 + envelope[blob[3] >> 1 & 7] :]) if blob else None
    return spark.createDataFrame([(*r[:-1], plain(r[-1])) for r in rows], schema).withColumn("srid", F.lit(srid))


def write_geopackage(layer: DataFrame, path: str, name: str = "segments", srid: int | None = None) -> None:
    """A new file with one layer of the table's columns; geometry is WKB. Null attributes stay null."""
    if os.path.exists(path):
        os.remove(path)
    columns = [f for f in layer.schema if f.name not in ("geometry", "srid")]
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.executescript(
            """
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
            """
        )
        srs = srid or 0
        for code in {-1, 0, 4326, srs}:
            db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (f"srs {code}", code, "EPSG" if code > 0 else "NONE", code))
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB' + "".join(f', "{f.name}" {SQL_TYPES.get(type(f.dataType), "TEXT")}' for f in columns) + ")")
        bounds = [float("inf"), float("inf"), float("-inf"), float("-inf")]
        head = struct.pack("<2sBBi", b"GP", 0, 1, srs)
        for r in layer.select("geometry", *(f.name for f in columns)).toLocalIterator():
            blob = None if r[0] is None else head + bytes(r[0])
            for x, y in wkb_coordinates(bytes(r[0])) if r[0] is not None else ():
                bounds = [min(bounds[0], x), min(bounds[1], y), max(bounds[2], x), max(bounds[3], y)]
            db.execute(f'INSERT INTO "{name}" (geom{"".join(f""", "{f.name}\"""" for f in columns)}) VALUES ({", ".join("?" * (len(columns) + 1))})', (blob, *r[1:]))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (name, name, *bounds, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srs))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Properties as strings, geometry (WKB) and srid 4326, of a feature collection or of a feature in each line."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<properties:map<string,string>,geometry:string>>").alias("v"), "value")
    features = whole.select(F.explode("v.features").alias("f")).select("f.*")
    names = sorted(r[0] for r in features.select(F.explode(F.map_keys("properties"))).distinct().collect())
    types = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("geometry", T.BinaryType())])

    def decoded(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({**{n: [dict(p or {}).get(n) for p in pdf["properties"]] for n in names}, "geometry": [from_geojson(json.loads(g)) if g else None for g in pdf["geometry"]]})

    return features.mapInPandas(decoded, types).withColumn("srid", F.lit(4326))


def write_geojson(layer: DataFrame, path: str) -> None:
    columns = [c for c in layer.columns if c not in ("geometry", "srid")]
    with open(path, "w") as out:
        out.write('{"type":"FeatureCollection","features":[')
        for k, r in enumerate(layer.toLocalIterator()):
            shown = {"type": "Feature", "properties": {c: r[c] for c in columns}, "geometry": to_geojson(bytes(r["geometry"])) if r["geometry"] is not None else None}
            out.write("," * (k > 0) + json.dumps(shown, default=str))
        out.write("]}")


def read_vector(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the ending: GeoPackage, GeoJSON or Parquet with WKB."""
    if path.endswith(".gpkg"):
        return read_geopackage(spark, path, **options)
    if path.endswith((".geojson", ".json")):
        return read_geojson(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"Unknown vector format: {path}")


def write_vector(layer: DataFrame, path: str, **options) -> None:
    if path.endswith(".gpkg"):
        write_geopackage(layer, path, **options)
    elif path.endswith((".geojson", ".json")):
        write_geojson(layer, path)
    elif path.endswith(".parquet"):
        layer.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"Unknown vector format: {path}")


def sample_geometries(layer: DataFrame, class_column: str = "class", srid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points (x, y) and the boxes of all other geometries, with class and sample_ord, from a layer of samples.

    srid: of the image that they are for. Samples are not reprojected: a layer whose own is known and another one is an
    error.
    """
    spark = layer.sparkSession
    if srid and "srid" in layer.columns and (own := layer.where((F.col("srid") > 0) & (F.col("srid") != srid)).select("srid").first()):
        raise ValueError(f"The samples are in EPSG:{own[0]}, the image in EPSG:{srid}; reproject them first")
    if class_column not in layer.columns:
        raise ValueError(f"No column {class_column!r} in the samples")
    points, boxes = [], []
    # training samples are drawn by hand: few
    for k, r in enumerate(layer.select("geometry", F.col(class_column).cast("string")).collect()):
        if r[0] is None:
            continue
        c = wkb_coordinates(bytes(r[0]))
        if struct.unpack_from("<I" if r[0][0] else ">I", r[0], 1)[0] % 1000 == 1:
            points.append((*c[0], r[1], k))
        elif c:
            xs, ys = zip(*c, strict=True)
            boxes.append((min(xs), min(ys), max(xs), max(ys), r[1], k))
    name = f"`{class_column}`"
    return spark.createDataFrame(points, f"x double, y double, {name} string, sample_ord int"), spark.createDataFrame(boxes, f"min_x double, min_y double, max_x double, max_y double, {name} string, sample_ord int")

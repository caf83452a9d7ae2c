"""Polygons of segments: unit edges by an anti-join, chained into rings for each segment, as WKB."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import image, keys, segments_of

#: row and column steps to the neighbour, and the edge between, from corner to corner, with the segment on its right.
EDGES = ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))


def outline(px: DataFrame) -> DataFrame:
    """r0, c0, r1, c1 of each unit edge between a segment's pixel and another segment, nodata or the outside."""
    by = image(px)
    own = segments_of(px).select(*keys(px), "row", "col")
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "a", "b", "c", "d"), e, strict=True)]) for e in EDGES])
    cast = own.select(*keys(px), "row", "col", F.explode(steps).alias("e"))
    cast = cast.select(*keys(px), (F.col("row") + F.col("e.dr")).alias("row"), (F.col("col") + F.col("e.dc")).alias("col"), *((F.col(x) + F.col(f"e.{k}")).alias(n) for n, x, k in (("r0", "row", "a"), ("c0", "col", "b"), ("r1", "row", "c"), ("c1", "col", "d"))))
    return cast.join(own, [*by, "row", "col", "segment_id"], "left_anti").select(*keys(px), "r0", "c0", "r1", "c1")


def rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of corners from directed unit edges, straight runs as one. Where two rings touch in a corner the
    turn keeps pixels that only meet there apart."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in sorted(edges):
        ahead.setdefault((r0, c0), []).append((r1, c1))
    out = []
    while ahead:
        start = min(ahead)
        at, ring, came = start, [start], None
        while True:
            options = ahead[at]
            if came is None or len(options) == 1:
                to = options[0]
            else:
                step = (at[0] - came[0], at[1] - came[1])
                right = (at[0] + step[1], at[1] - step[0])
                to = right if right in options else options[0]
            options.remove(to)
            if not options:
                del ahead[at]
            came, at = at, to
            if at == start:
                break
            ring.append(at)
        turns = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0], p[1] - ring[k - 1][1]) != (ring[(k + 1) % len(ring)][0] - p[0], ring[(k + 1) % len(ring)][1] - p[1])]
        out.append([*turns, turns[0]])
    return out


def area(ring: list[tuple[float, float]]) -> float:
    """Signed area, positive for outer rings as EDGES turns them."""
    return sum(c0 * r1 - c1 * r0 for (r0, c0), (r1, c1) in zip(ring, ring[1:], strict=False)) / 2


def holds(ring: list[tuple[int, int]], r: float, c: float) -> bool:
    inside = False
    for (r0, c0), (r1, c1) in zip(ring, ring[1:], strict=False):
        if (r0 > r) != (r1 > r) and c < (c1 - c0) * (r - r0) / (r1 - r0) + c0:
            inside = not inside
    return inside


def polygons(edges: list[tuple[int, int, int, int]]) -> list[list[list[tuple[int, int]]]]:
    """Polygons as an outer ring and its holes."""
    found = rings(edges)
    outer = [[r] for r in found if area(r) > 0]
    for ring in (r for r in found if area(r) <= 0):
        (r0, c0), (r1, c1) = ring[0], ring[1]
        # a point just inside the pixels beside the hole's first edge
        r, c = (r0 + r1) / 2 + (c1 > c0) * 0.25 - (c1 < c0) * 0.25, (c0 + c1) / 2 + (r1 < r0) * 0.25 - (r1 > r0) * 0.25
        owners = [p for p in outer if holds(p[0], r, c)]
        min(owners, key=lambda p: area(p[0])).append(ring)
    return outer


def wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """A polygon, or a multipolygon of several, of (x, y) rings."""
    one = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon as wkb() writes them."""
    found, at, left = [], 0, 1
    while left:
        kind, n = struct.unpack_from("<xII", data, at)
        at += 9
        if kind == 6:
            left = n
            continue
        for _ in range(n):
            m = struct.unpack_from("<I", data, at)[0]
            flat = struct.unpack_from(f"<{2 * m}d", data, at + 4)
            found.append(list(zip(flat[::2], flat[1::2], strict=True)))
            at += 4 + 16 * m
        left -= 1
    return found


def measured(layer: DataFrame) -> DataFrame:
    """layer with the area of its polygons (holes taken off), their number of rings, and min_x, max_x, min_y, max_y, in
    place of the geometry."""
    names = [c for c in layer.columns if c != "geometry"]
    types = {f.name: f.dataType.simpleString() for f in layer.schema}

    def measure(batches):
        for pdf in batches:
            rows = []
            for data in pdf["geometry"]:
                parts = wkb_rings(bytes(data))
                xs, ys = zip(*(p for r in parts for p in r), strict=True)
                signed = sum(x0 * y1 - x1 * y0 for r in parts for (x0, y0), (x1, y1) in zip(r, r[1:], strict=False)) / 2
                rows.append((abs(signed), len(parts), min(xs), max(xs), min(ys), max(ys)))
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(rows, columns=["area", "n_rings", "min_x", "max_x", "min_y", "max_y"])], axis=1)

    return layer.mapInPandas(measure, ", ".join(f"{n} {types[n]}" for n in names) + ", area double, n_rings int, min_x double, max_x double, min_y double, max_y double")


def vectorize(px: DataFrame, transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), srid: int = 0) -> DataFrame:
    """segment_id, geometry (WKB), srid: one row for each segment, its pieces over sides in one geometry. Python gets
    the outline only, whose length is that of the result."""
    by = keys(px)
    edges = outline(px)
    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    a, b, c, d, e, f = map(float, transform)

    def traced(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = polygons(list(zip(*(pdf[n].tolist() for n in ("r0", "c0", "r1", "c1")), strict=True)))
        mapped = [[[(a * x + b * y + c, d * x + e * y + f) for y, x in ring] for ring in rings] for rings in parts]
        out = pdf[by].iloc[:1].copy()
        out["geometry"] = [wkb(mapped)]
        return out

    found = edges.groupBy(*by).applyInPandas(traced, ", ".join(f"{n} {types[n]}" for n in by) + ", geometry binary")
    return found.withColumn("srid", F.lit(srid))


def with_attributes(polygons: DataFrame, attributes: DataFrame) -> DataFrame:
    """All polygons, with the attributes of those that have some."""
    return polygons.join(attributes, keys(polygons), "left")

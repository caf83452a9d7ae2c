"""Every operator as a query over the star schema, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy, change, context, explore, features, fuzzy, geometry, hierarchy, labels, samples, segment, spectral, supervised, texture, unsupervised, vectorize
from . import grid
from .pipeline import Pipeline, batch_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A grid as in grid.pixels, with the label left open.
_PX = """
px AS (
  SELECT CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col,
         CAST(floor(o_totalprice / 1000) AS DOUBLE) AS b0, CAST(floor(c_acctbal / 10) AS DOUBLE) AS b1, CAST(coalesce(u.b2, 0) AS DOUBLE) AS b2,
         CAST({label} AS INTEGER) AS segment_id
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(floor(l_quantity)) AS b2 FROM lineitem GROUP BY l_orderkey) u ON l_orderkey = o_orderkey)"""
_BLOCK = "1 + (o_orderkey // 100) // 5 * 10 + (o_orderkey % 100) // 10"
_SHEAR = "1 + (o_orderkey // 100) // 5 * 10 + ((o_orderkey % 100 + (o_orderkey // 100) % 5) % 100) // 10"
_GAPS = "CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE {} END"
PX = _PX.format(label=_GAPS.format(_BLOCK))
SHEARED = _PX.format(label=_GAPS.format(_SHEAR))
COARSE = _PX.format(label="1 + (o_orderkey // 100) // 8 * 3 + (o_orderkey % 100) // 37").replace("px AS", "coarse AS", 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _spectral_sql(px: str, bad: str = "", names: tuple[str, ...] = ("band_0", "band_1", "band_2")) -> str:
    keep = f" FILTER (NOT ({bad}))" if bad else ""
    each = ", ".join(
        f"round(avg(b{i}){keep}, 6) AS mean_{n}, round(stddev_pop(b{i}){keep}, 6) AS std_{n}, min(b{i}){keep} AS min_{n}, max(b{i}){keep} AS max_{n}, round(median(b{i}){keep}, 6) AS median_{n}, max(b{i}){keep} - min(b{i}){keep} AS range_{n}"
        for i, n in enumerate(names)
    )
    mean = " + ".join(f"avg(b{i}){keep}" for i in range(3))
    return f"WITH {px} SELECT segment_id, {each}, round(({mean}) / 3, 6) AS brightness FROM px WHERE segment_id > 0 GROUP BY segment_id"


@query(_spectral_sql(PX))
def spectral_stats(spark, sf):
    return rounded(spectral.spectral(grid.pixels(spark, sf), ratios=False))


@query(_spectral_sql(PX.replace("AS b0,", "AS b0_,", 1).replace("px AS (", "raw AS (", 1) + ", px AS (SELECT *, CASE WHEN (\"row\" * 100 + col) % 11 = 0 THEN -9999 ELSE b0_ END AS b0 FROM raw)", "b0 = -9999 OR b1 = -9999 OR b2 = -9999"))
def spectral_nodata(spark, sf):
    px = grid.pixels(spark, sf)
    px = px.withColumn("b0", F.when((F.col("row") * 100 + F.col("col")) % 11 == 0, -9999.0).otherwise(F.col("b0")))
    return rounded(spectral.spectral(px, ratios=False, nodata=-9999.0))


_MEANS = "m AS (SELECT segment_id, avg(b0) AS m0, avg(b1) AS m1, avg(b2) AS m2 FROM px WHERE segment_id > 0 GROUP BY segment_id)"
_RATIO = "round(CASE WHEN {a} + {b} = 0 THEN 0 ELSE ({a} - {b}) / ({a} + {b}) END, 6)"


@query(f"WITH {PX}, {_MEANS} SELECT segment_id, {_RATIO.format(a='m1', b='m0')} AS ndvi, {_RATIO.format(a='m2', b='m1')} AS ndwi FROM m")
def band_ratios(spark, sf):
    out = spectral.spectral(grid.pixels(spark, sf), {"red": 0, "nir": 1, "green": 2})
    return rounded(out.select("segment_id", "ndvi", "ndwi"))


@query(f"WITH {PX}, {_MEANS} SELECT segment_id, round((m0 + m1 + m2) / 3, 6) AS brightness FROM m")
def brightness(spark, sf):
    return rounded(spectral.spectral(grid.pixels(spark, sf), ratios=False).select("segment_id", "brightness"))


@query(f"WITH {PX} SELECT segment_id, count(*) AS size FROM px WHERE segment_id > 0 GROUP BY segment_id")
def segment_sizes(spark, sf):
    return labels.segment_sizes(grid.pixels(spark, sf))


@query(f"WITH {PX} SELECT count(DISTINCT segment_id) AS n_segments FROM px WHERE segment_id > 0")
def count_segments(spark, sf):
    return labels.count_segments(grid.pixels(spark, sf))


@query(f'WITH {PX}, ids AS (SELECT segment_id, dense_rank() OVER (ORDER BY segment_id) AS k FROM (SELECT DISTINCT segment_id FROM px WHERE segment_id > 0)) SELECT "row", col, CAST(coalesce(k, 0) AS INTEGER) AS segment_id FROM px LEFT JOIN ids USING (segment_id)')
def relabel_sequential(spark, sf):
    px = grid.pixels(spark, sf).withColumn("segment_id", F.col("segment_id") * 3)
    return labels.relabel_sequential(px).select("row", "col", "segment_id")


@query(f'WITH {PX} SELECT segment_id, min("row") AS row_start, max("row") + 1 AS row_stop, min(col) AS col_start, max(col) + 1 AS col_stop FROM px WHERE segment_id > 0 GROUP BY segment_id')
def segment_bbox(spark, sf):
    return labels.segment_slices(grid.pixels(spark, sf))


@query(f"WITH {PX.replace('AS segment_id', 'AS segment_id, o_orderstatus AS status', 1)} SELECT \"row\", col, CASE WHEN status = 'P' THEN 0 ELSE segment_id END AS segment_id FROM px")
def mask_labels(spark, sf):
    status = grid.read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), "o_orderstatus")
    px = grid.pixels(spark, sf).join(status, ["row", "col"])
    return labels.mask_labels(px, F.col("o_orderstatus") == "P").select("row", "col", "segment_id")


@query(f'WITH {SHEARED} SELECT segment_id, count(*) AS area_px, round(avg("row"), 6) AS centroid_y, round(avg(col), 6) AS centroid_x FROM px WHERE segment_id > 0 GROUP BY segment_id')
def geometry_area_centroid(spark, sf):
    return rounded(geometry.moments(grid.pixels(spark, sf, sheared=True)).select("segment_id", "area_px", "centroid_y", "centroid_x"))


_MOMENTS = """m AS (
  SELECT segment_id, avg("row" * "row") - avg("row") ** 2 AS rr, avg(col * col) - avg(col) ** 2 AS cc, avg("row" * col) - avg("row") * avg(col) AS rc
  FROM px WHERE segment_id > 0 GROUP BY segment_id),
l AS (SELECT *, greatest(0, (rr + cc) / 2 + sqrt(((rr - cc) / 2) ** 2 + rc ** 2)) AS l1, greatest(0, (rr + cc) / 2 - sqrt(((rr - cc) / 2) ** 2 + rc ** 2)) AS l2 FROM m)"""


@query(f"WITH {SHEARED}, {_MOMENTS} SELECT segment_id, round(4 * sqrt(l1), 6) AS major_axis_length, round(4 * sqrt(l2), 6) AS minor_axis_length, round(CASE WHEN l1 > 0 THEN sqrt(greatest(0, 1 - l2 / l1)) ELSE 0 END, 6) AS eccentricity, round(CASE WHEN rr = cc THEN CASE WHEN rc > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE atan2(2 * rc, rr - cc) / 2 END, 6) AS orientation FROM l")
def geometry_axes(spark, sf):
    out = geometry.moments(grid.pixels(spark, sf, sheared=True))
    return rounded(out.select("segment_id", "major_axis_length", "minor_axis_length", "eccentricity", "orientation"))


_NEAR = "(a.segment_id = b.segment_id AND b.\"row\" = a.\"row\" + s.r AND b.col = a.col + s.c)"
_PERIMETER = f"""own AS (SELECT segment_id, "row", col FROM px WHERE segment_id > 0),
steps AS (SELECT * FROM (VALUES (0, 1, 2), (0, -1, 2), (1, 0, 2), (-1, 0, 2), (1, 1, 10), (1, -1, 10), (-1, 1, 10), (-1, -1, 10)) AS t(r, c, w)),
n AS (SELECT a.segment_id, a."row", a.col, count(*) AS n FROM own a CROSS JOIN steps s JOIN own b ON {_NEAR} WHERE s.w = 2 GROUP BY ALL),
edge AS (SELECT own.* FROM own LEFT JOIN n USING (segment_id, "row", col) WHERE coalesce(n, 0) < 4),
code AS (SELECT a.segment_id, a."row", a.col, sum(s.w) AS code FROM edge a CROSS JOIN steps s JOIN edge b ON {_NEAR} GROUP BY ALL),
k AS (SELECT segment_id, 1 + coalesce(code, 0) AS code FROM edge LEFT JOIN code USING (segment_id, "row", col)),
perimeter AS (
  SELECT segment_id, count(*) FILTER (code IN (5, 7, 15, 17, 25, 27)) * 1.0 + count(*) FILTER (code IN (21, 33)) * sqrt(2::DOUBLE) + count(*) FILTER (code IN (13, 23)) * ((1 + sqrt(2::DOUBLE)) / 2) AS perimeter
  FROM k GROUP BY segment_id)"""


@query(f"WITH {SHEARED}, {_PERIMETER} SELECT segment_id, round(perimeter, 6) AS perimeter FROM perimeter")
def geometry_perimeter(spark, sf):
    return rounded(geometry.perimeter(grid.pixels(spark, sf, sheared=True)))


@query(f"""WITH {SHEARED}, {_PERIMETER}, {_MOMENTS},
a AS (SELECT segment_id, count(*) AS n, (max("row") - min("row") + 1) * (max(col) - min(col) + 1) AS box FROM px WHERE segment_id > 0 GROUP BY segment_id)
SELECT segment_id, round(n * 100.0::DOUBLE, 6) AS area, round(perimeter * 10, 6) AS perimeter,
       round(CASE WHEN perimeter > 0 THEN n * 100 * 4 * pi() / ((perimeter * 10) * (perimeter * 10)) ELSE 0 END, 6) AS compactness,
       round(CASE WHEN l2 > 0 THEN sqrt(l1) * 4 / (sqrt(l2) * 4) ELSE 0 END, 6) AS elongation, round(n / box, 6) AS rectangularity
FROM a JOIN perimeter USING (segment_id) JOIN l USING (segment_id)""")
def geometry_compactness(spark, sf):
    out = geometry.geometry(grid.pixels(spark, sf, sheared=True), pixel_size=10)
    return rounded(out.select("segment_id", "area", "perimeter", "compactness", "elongation", "rectangularity"))


@query()
def geometry_solidity(spark, sf):
    return rounded(geometry.solidity(grid.pixels(spark, sf, sheared=True)))


_EDGES = """own AS (SELECT segment_id, "row", col FROM px WHERE segment_id > 0),
half AS (
  SELECT a.segment_id AS src, b.segment_id AS dst FROM own a JOIN own b ON b."row" = a."row" AND b.col = a.col + 1 WHERE a.segment_id <> b.segment_id
  UNION SELECT a.segment_id, b.segment_id FROM own a JOIN own b ON b."row" = a."row" + 1 AND b.col = a.col WHERE a.segment_id <> b.segment_id),
edges AS (SELECT src, dst FROM half UNION SELECT dst, src FROM half)"""


@query(f"WITH {SHEARED}, {_EDGES} SELECT src, dst FROM edges")
def adjacency(spark, sf):
    return context.adjacency(grid.pixels(spark, sf, sheared=True))


@query(f"""WITH {SHEARED}, {_EDGES}, {_MEANS},
met AS (
  SELECT src AS segment_id, b.m0 + b.m1 + b.m2 AS s, b.m0 * b.m0 + b.m1 * b.m1 + b.m2 * b.m2 AS ss, (abs(a.m0 - b.m0) + abs(a.m1 - b.m1) + abs(a.m2 - b.m2)) / 3 AS d
  FROM edges JOIN m a ON a.segment_id = src JOIN m b ON b.segment_id = dst),
k AS (SELECT segment_id, count(*) AS n, avg(s) / 3 AS mean, avg(ss) / 3 AS squares, avg(d) AS d FROM met GROUP BY segment_id)
SELECT segment_id, coalesce(n, 0) AS n_neighbors, round(coalesce(mean, 0), 5) AS mean_neighbor_brightness,
       round(coalesce(sqrt(greatest(0, squares - mean ** 2)), 0), 5) AS std_neighbor_brightness, round(coalesce(d, 0), 5) AS border_contrast
FROM m LEFT JOIN k USING (segment_id)""")
def context_features(spark, sf):
    return rounded(context.context(grid.pixels(spark, sf, sheared=True)), 5)


_GLCM = """bands AS (SELECT segment_id, "row", col, unnest([0, 1, 2]) AS band, unnest([b0, b1, b2]) AS x FROM px),
gray AS (
  SELECT segment_id, "row", col, band, CAST(floor(greatest(0, least(31, (x - low) / (high - low) * 31))) AS INTEGER) AS g
  FROM bands JOIN (SELECT band, min(x) AS low, max(x) AS high FROM bands GROUP BY band) USING (band) WHERE segment_id > 0),
steps AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) AS t(pair, r, c)),
one AS (
  SELECT a.segment_id, a.band, pair, a.g AS i, b.g AS j, count(*) AS n
  FROM gray a CROSS JOIN steps s JOIN gray b ON b.segment_id = a.segment_id AND b.band = a.band AND b."row" = a."row" + s.r AND b.col = a.col + s.c GROUP BY ALL),
both_ways AS (SELECT segment_id, band, pair, i, j, sum(n) AS n FROM (SELECT * FROM one UNION ALL SELECT segment_id, band, pair, j, i, n FROM one) GROUP BY ALL),
sums AS (
  SELECT segment_id, band, pair, CAST(sum(n) AS DOUBLE) AS a, CAST(sum(n * (i - j) * (i - j)) AS DOUBLE) AS con, CAST(sum(n * abs(i - j)) AS DOUBLE) AS dis, sum(CAST(n AS DOUBLE) / (1 + (i - j) * (i - j))) AS hom,
         CAST(sum(n * n) AS DOUBLE) AS en, CAST(sum(n * i) AS DOUBLE) AS si, CAST(sum(n * i * i) AS DOUBLE) AS sii, CAST(sum(n * i * j) AS DOUBLE) AS sij
  FROM both_ways GROUP BY ALL),
v AS (
  SELECT segment_id, band, pair, con / a AS contrast, dis / a AS dissimilarity, hom / a AS homogeneity, sqrt(en) / a AS energy,
         CASE WHEN a * sii - si * si = 0 THEN 1 ELSE (a * sij - si * si) / (a * sii - si * si) END AS correlation FROM sums),
sizes AS (SELECT segment_id, count(*) AS n FROM px WHERE segment_id > 0 GROUP BY segment_id)"""


def _glcm_mean(p: str, band: int) -> str:
    other = 1 if p == "correlation" else 0
    return "round(CASE WHEN any_value(n) < 4 THEN 0 ELSE (" + " + ".join(f"coalesce(max({p}) FILTER (band = {band} AND pair = {k}), {other})" for k in range(4)) + f") / 4 END, 6) AS glcm_{p}_b{band}"


@query(f"WITH {SHEARED}, {_GLCM} SELECT segment_id, {', '.join(_glcm_mean(p, b) for b in range(3) for p in texture.PROPERTIES)} FROM sizes LEFT JOIN v USING (segment_id) GROUP BY segment_id")
def texture_glcm(spark, sf):
    return rounded(texture.texture(grid.pixels(spark, sf, sheared=True)))


# labels of another grid have ids that these don't
@query(f"WITH {PX}, {COARSE}, {_MEANS}, a AS (SELECT segment_id, count(*) AS size FROM coarse WHERE segment_id > 0 GROUP BY segment_id), b AS (SELECT segment_id, round(m0, 6) AS mean FROM m) SELECT segment_id, size, mean FROM a FULL JOIN b USING (segment_id)")
def features_outer_merge(spark, sf):
    sizes = labels.segment_sizes(grid.coarse_pixels(spark, sf))
    means = spectral.spectral(grid.pixels(spark, sf), ratios=False).select("segment_id", F.round("mean_band_0", 6).alias("mean"))
    return features.merged([sizes, means])


_TILED = """ends AS (SELECT max("row") AS rows, max(col) AS cols FROM px),
tiles AS (SELECT CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, r * 24 AS row_off, c * 24 AS col_off FROM ends, unnest(range(rows // 24 + 1)) AS a(r), unnest(range(cols // 24 + 1)) AS b(c)),
tiled AS (SELECT px.*, tiles.* FROM px JOIN tiles ON "row" >= row_off AND "row" < row_off + 32 AND col >= col_off AND col < col_off + 32)"""


@query(f'WITH {PX}, {_TILED} SELECT tile_row, tile_col, count(*) AS n, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max FROM tiled GROUP BY tile_row, tile_col')
def tile_windows(spark, sf):
    tiled = segment.tile_windows(grid.pixels(spark, sf), 32, 8)
    return tiled.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


@query(f"WITH {PX}, {_TILED}, t AS (SELECT tile_row, tile_col, count(DISTINCT segment_id) AS max_label FROM tiled GROUP BY tile_row, tile_col) SELECT tile_row, tile_col, max_label, CAST(coalesce(sum(max_label) OVER (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS label_offset FROM t")
def tile_label_offset(spark, sf):
    tiled = segment.tile_windows(grid.pixels(spark, sf), 32, 8)
    tiles = tiled.groupBy("tile_row", "tile_col").agg(F.countDistinct("segment_id").alias("max_label")).withColumn("tile_seq", segment.tile_sequence(tiled))
    return hierarchy.tile_label_offsets(tiles).select("tile_row", "tile_col", "max_label", "label_offset")


@query(f"""WITH {PX}, {_TILED},
l AS (SELECT *, 1 + ("row" - row_off) // 8 * 4 + (col - col_off) // 8 AS label FROM tiled),
t AS (SELECT tile_row, tile_col, max(label) AS most FROM l GROUP BY tile_row, tile_col),
o AS (SELECT tile_row, tile_col, coalesce(sum(most) OVER (ORDER BY tile_row, tile_col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t),
core AS (
  SELECT "row", col, label + off AS id, tile_row * 1000 + tile_col AS seq FROM l JOIN o USING (tile_row, tile_col), ends
  WHERE "row" >= CASE WHEN row_off > 0 THEN row_off + 4 ELSE 0 END AND "row" < CASE WHEN row_off + 32 <= rows THEN row_off + 28 ELSE rows + 1 END
    AND col >= CASE WHEN col_off > 0 THEN col_off + 4 ELSE 0 END AND col < CASE WHEN col_off + 32 <= cols THEN col_off + 28 ELSE cols + 1 END)
SELECT "row", col, CAST(arg_max(id, seq) AS INTEGER) AS segment_id FROM core GROUP BY "row", col""")
def tile_core_stitch(spark, sf):
    tiled = segment.tile_windows(grid.pixels(spark, sf), 32, 8)
    label = (1 + F.floor((F.col("row") - F.col("row_off")) / 8) * 4 + F.floor((F.col("col") - F.col("col_off")) / 8)).cast("int")
    from pyspark.sql import Window

    marked = tiled.withColumn("label", label)
    marked = marked.withColumn("max_label", F.max("label").over(Window.partitionBy("tile_row", "tile_col")).cast("bigint"))
    return segment.stitched(marked, 32, 8)


_PARENTS = """met AS (SELECT a.segment_id, b.segment_id AS parent_id, count(*) AS n FROM px a JOIN coarse b ON a."row" = b."row" AND a.col = b.col WHERE a.segment_id > 0 AND b.segment_id > 0 GROUP BY ALL),
parents AS (SELECT segment_id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, parent_id) AS k FROM met) WHERE k = 1)"""


@query(f"WITH {PX}, {COARSE}, {_PARENTS} SELECT segment_id, parent_id FROM parents")
def multiscale_parent(spark, sf):
    return hierarchy.parent_map(grid.pixels(spark, sf), grid.coarse_pixels(spark, sf))


@query(f"""WITH {PX}, {COARSE}, {_PARENTS}
SELECT p.segment_id, p.parent_id, round(f.n / c.n, 6) AS area_ratio, count(*) OVER (PARTITION BY p.parent_id) AS n_siblings
FROM parents p JOIN (SELECT segment_id, count(*) AS n FROM px GROUP BY 1) f ON f.segment_id = p.segment_id JOIN (SELECT segment_id, count(*) AS n FROM coarse GROUP BY 1) c ON c.segment_id = p.parent_id""")
def cross_scale(spark, sf):
    return rounded(hierarchy.cross_scale_features(grid.pixels(spark, sf), grid.coarse_pixels(spark, sf)))


@query(f"""WITH {PX}, p AS (SELECT c_custkey * 13 % 160 AS "row", c_custkey * 37 % 110 AS col, 'k' || (c_custkey % 4) AS class, c_custkey AS ord FROM customer)
SELECT segment_id, arg_max(class, ord) AS class_label FROM p JOIN px USING ("row", col) WHERE segment_id > 0 GROUP BY segment_id""")
def training_points(spark, sf):
    return samples.point_samples(grid.points(spark, sf), grid.pixels(spark, sf), grid.TRANSFORM)


@query(f"""WITH {PX}, b AS (
  SELECT s_suppkey * 7 % 160 AS r0, s_suppkey * 7 % 160 + s_suppkey % 5 AS r1, s_suppkey * 11 % 110 - 2 AS c0, s_suppkey * 11 % 110 + s_suppkey % 4 AS c1, 's' || (s_suppkey % 3) AS class, s_suppkey AS ord FROM supplier)
SELECT segment_id, arg_max(class, ord) AS class_label FROM b JOIN px ON "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 WHERE segment_id > 0 GROUP BY segment_id""")
def training_bbox(spark, sf):
    return samples.box_samples(grid.boxes(spark, sf), grid.pixels(spark, sf), grid.TRANSFORM)


def _period_sql(name: str, sign: str) -> str:
    return f"{name} AS (SELECT CAST(l_suppkey + 1 AS INTEGER) AS segment_id, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(floor(l_quantity)) AS DOUBLE) AS units, sum(round(l_discount * 100)) AS rebate FROM lineitem WHERE l_shipdate {sign} TIMESTAMP '1998-07-01' GROUP BY 1)"


_PERIODS = _period_sql("t1", "<") + ", " + _period_sql("t2", ">=")
_FEATURES = ("lines", "units", "rebate")
_MAGNITUDE = f"""pooled AS (SELECT {', '.join(f'coalesce(nullif(stddev_samp({c}), 0), 1) AS s_{c}' for c in _FEATURES)} FROM (SELECT t1.* FROM t1 SEMI JOIN t2 USING (segment_id) UNION ALL SELECT t2.* FROM t2 SEMI JOIN t1 USING (segment_id))),
size AS (SELECT t1.segment_id, sqrt({' + '.join(f'((t2.{c} - t1.{c}) / s_{c}) * ((t2.{c} - t1.{c}) / s_{c})' for c in _FEATURES)}) AS v FROM t1 JOIN t2 USING (segment_id), pooled)"""


@query(f"WITH {_PERIODS} SELECT segment_id, {', '.join(f't2.{c} - t1.{c} AS {c}' for c in _FEATURES)} FROM t1 JOIN t2 USING (segment_id)")
def feature_difference(spark, sf):
    return change.feature_difference(grid.period(spark, sf, False), grid.period(spark, sf, True))


@query(f"WITH {_PERIODS}, {_MAGNITUDE} SELECT segment_id, round(v, 6) AS change_magnitude FROM size")
def change_magnitude(spark, sf):
    return rounded(change.change_magnitude(grid.period(spark, sf, False), grid.period(spark, sf, True)))


@query(f"WITH {_PERIODS} SELECT segment_id, sqrt({' + '.join(f'(t2.{c} - t1.{c}) ** 2' for c in _FEATURES)}) > 150 AS changed FROM t1 JOIN t2 USING (segment_id)")
def detect_changes_fixed(spark, sf):
    return change.detect_changes(grid.period(spark, sf, False), grid.period(spark, sf, True), 150, normalize=False)


_OTSU = """ends AS (SELECT min(v) AS low, max(v) AS high FROM size),
bins AS (SELECT bin, low + (high - low) / 256 * (bin + 0.5) AS centre, coalesce(n, 0) AS n FROM ends, unnest(range(256)) AS r(bin) LEFT JOIN (SELECT least(255, CAST(floor((v - low) * 256 / (high - low)) AS BIGINT)) AS bin, count(*) AS n FROM size, ends GROUP BY 1) USING (bin)),
sums AS (SELECT bin, centre, sum(n) OVER a AS w1, sum(n * centre) OVER a AS s1, sum(n) OVER b AS w2, sum(n * centre) OVER b AS s2 FROM bins WINDOW a AS (ORDER BY bin), b AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
cut AS (SELECT arg_max(centre, w1 * w2 * (s1 / nullif(w1, 0) - s2 / nullif(w2, 0)) ** 2) AS centre FROM sums WHERE w1 > 0 AND w2 > 0),
changes AS (SELECT segment_id, v > centre AS changed FROM size, cut)"""


@query(f"WITH {_PERIODS}, {_MAGNITUDE}, {_OTSU} SELECT segment_id, changed FROM changes")
def detect_changes_otsu(spark, sf):
    return change.detect_changes(grid.period(spark, sf, False), grid.period(spark, sf, True))


@query(f"WITH {_PERIODS}, {_MAGNITUDE}, {_OTSU}, d AS (SELECT {', '.join(f'round(avg(t2.{c} - t1.{c}), 6) AS mean_diff_{c}' for c in _FEATURES)} FROM t1 JOIN t2 USING (segment_id) JOIN changes USING (segment_id) WHERE changed) SELECT count(*) AS total_segments, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, round(count(*) FILTER (changed) / count(*) * 100, 1) AS pct_changed, {', '.join(f'any_value(mean_diff_{c}) AS mean_diff_{c}' for c in _FEATURES)} FROM changes, d")
def change_summary(spark, sf):
    t1, t2 = grid.period(spark, sf, False), grid.period(spark, sf, True)
    out = change.change_summary(change.detect_changes(t1, t2), t1, t2)
    return rounded(out.select("total_segments", "changed", "unchanged", "pct_changed", *(F.col("mean_diff_changed")[c].alias(f"mean_diff_{c}") for c in _FEATURES)))


RULES = {
    "dear": [fuzzy.FuzzyRule("mean_band_0", 270, 1000, low_edge=230)],
    "cheap": [fuzzy.FuzzyRule("mean_band_0", 0, 230, high_edge=260), fuzzy.FuzzyRule("mean_band_1", -200, 450, high_edge=520)],
    "rich": [fuzzy.FuzzyRule("mean_band_1", 470, 1000, low_edge=430)],
}


def _member_sql(x: str, low: float, high: float, a: float | None = None, d: float | None = None) -> str:
    out = f"CASE WHEN {x} BETWEEN {low} AND {high} THEN 1.0"
    out += f" WHEN {x} >= {a} AND {x} < {low} THEN ({x} - {a}) / {low - a}::DOUBLE" if a is not None else ""
    out += f" WHEN {x} > {high} AND {x} <= {d} THEN 1 - ({x} - {high}) / {d - high}::DOUBLE" if d is not None else ""
    return out + " ELSE 0.0 END"


_FUZZY = "g AS (SELECT segment_id, " + ", ".join(
    f"CAST({'least(' if len(rules) > 1 else '('}{', '.join(_member_sql('m' + r.feature[-1], r.low, r.high, r.low_edge, r.high_edge) for r in rules)}) AS DOUBLE) AS {c}" for c, rules in RULES.items()
) + " FROM m), classes AS (SELECT segment_id, CASE WHEN greatest(dear, cheap, rich) <= 0 THEN 'unclassified' WHEN dear = greatest(dear, cheap, rich) THEN 'dear' WHEN cheap = greatest(dear, cheap, rich) THEN 'cheap' ELSE 'rich' END AS class_label FROM g)"


def _means(spark, sf):
    return spectral.spectral(grid.pixels(spark, sf), ratios=False)


def _classes(spark, sf):
    return fuzzy.FuzzyClassifier(RULES).predict(_means(spark, sf))


@query(f"WITH {PX}, {_MEANS}, {_FUZZY} SELECT segment_id, round(dear, 6) AS dear, round(cheap, 6) AS cheap, round(rich, 6) AS rich FROM g")
def fuzzy_membership(spark, sf):
    return rounded(fuzzy.FuzzyClassifier(RULES).predict_proba(_means(spark, sf)))


@query(f"WITH {PX}, {_MEANS}, {_FUZZY} SELECT segment_id, class_label FROM classes")
def fuzzy_predict(spark, sf):
    return _classes(spark, sf)


@query(f"WITH {PX}, {_MEANS}, {_FUZZY} SELECT class_label, count(*) AS count, round(count(*) * 100 / sum(count(*)) OVER (), 1) AS pct FROM classes GROUP BY class_label")
def class_frequency(spark, sf):
    return explore.class_frequency(_classes(spark, sf))


_PAIRS = "pairs AS (SELECT 'c' || label AS t, 'c' || ((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 11) AS p FROM embeddings)"


@query(f"WITH {_PAIRS}, c AS (SELECT DISTINCT t FROM pairs) SELECT a.t AS \"true\", b.t AS predicted, (SELECT count(*) FROM pairs WHERE pairs.t = a.t AND pairs.p = b.t) AS n FROM c a, c b")
def confusion_matrix(spark, sf):
    return accuracy.confusion_matrix(*grid.labelled(spark, sf))


@query(f"""WITH {_PAIRS}, r AS (SELECT t AS label, count(*) AS n FROM pairs GROUP BY 1), c AS (SELECT p AS label, count(*) AS n FROM pairs GROUP BY 1),
e AS (SELECT sum(r.n * c.n) AS chance FROM r JOIN c USING (label)), k AS (SELECT count(*) AS n, count(*) FILTER (t = p) AS hits FROM pairs)
SELECT n, round(hits / n, 6) AS overall_accuracy, round(CAST(hits * n - chance AS DOUBLE) / (n * n - chance), 6) AS kappa FROM k, e""")
def accuracy_kappa(spark, sf):
    return rounded(accuracy.overall(*grid.labelled(spark, sf)))


@query(f"""WITH {_PAIRS}, r AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = p) AS hits FROM pairs GROUP BY 1), c AS (SELECT p AS label, count(*) AS given FROM pairs GROUP BY 1)
SELECT label AS class_label, round(CASE WHEN coalesce(given, 0) = 0 THEN 0 ELSE hits / given END, 6) AS precision, round(hits / support, 6) AS recall, round(2 * hits / (coalesce(given, 0) + support), 6) AS f1, support
FROM r LEFT JOIN c USING (label)""")
def per_class_metrics(spark, sf):
    return rounded(accuracy.per_class(*grid.labelled(spark, sf)))


@query(f'WITH {PX}, {_MEANS}, {_FUZZY}, k AS (SELECT class_label, row_number() OVER (ORDER BY class_label) AS code FROM (SELECT DISTINCT class_label FROM classes)) SELECT "row", col, CAST(coalesce(code, 0) AS INTEGER) AS code FROM px LEFT JOIN (SELECT segment_id, code FROM classes JOIN k USING (class_label)) USING (segment_id)')
def classified_raster(spark, sf):
    return explore.classified_raster(grid.pixels(spark, sf), _classes(spark, sf)).withColumn("code", F.col("code").cast("int"))


def _summary_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median, count({c}) AS count FROM m"


@query(f"WITH {PX}, {_MEANS} " + " UNION ALL ".join(map(_summary_sql, ("m0", "m1", "m2"))))
def feature_summary(spark, sf):
    means = _means(spark, sf).select("segment_id", *(F.col(f"mean_band_{i}").alias(f"m{i}") for i in range(3)))
    return rounded(explore.feature_summary(means))


@query(f"""WITH {PX}, {_MEANS}, e AS (SELECT min(m0) AS lo, max(m0) AS hi, least(50, greatest(10, count(*) // 20)) AS size FROM m),
c AS (SELECT least(size - 1, CAST(floor((m0 - lo) * size / (hi - lo)) AS INTEGER)) AS bin, count(*) AS n FROM m, e GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (hi - lo) / size * bin, 6) AS low, round(lo + (hi - lo) / size * (bin + 1), 6) AS high, coalesce(n, 0) AS n FROM e, unnest(range(size)) AS r(bin) LEFT JOIN c USING (bin)""")
def histogram(spark, sf):
    return rounded(explore.histogram(_means(spark, sf), "mean_band_0"))


@query(f"WITH {PX}, {_MEANS}, e AS (SELECT min(m0) AS lo, max(m0) AS hi FROM m) SELECT segment_id, CAST(least(4, floor((m0 - lo) * 5 / (hi - lo))) AS INTEGER) AS interval FROM m, e")
def equal_interval(spark, sf):
    return explore.equal_intervals(_means(spark, sf), "mean_band_0")


@query(f"WITH {PX}, {_MEANS}, {_FUZZY} SELECT segment_id, size, class_label FROM (SELECT segment_id, count(*) AS size FROM px WHERE segment_id > 0 GROUP BY 1) LEFT JOIN classes USING (segment_id)")
def vector_attribute_join(spark, sf):
    return vectorize.with_attributes(labels.segment_sizes(grid.pixels(spark, sf)), _classes(spark, sf))


@query("SELECT 'c' || label AS class_label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def balanced_weights(spark, sf):
    return rounded(supervised.balanced_weights(grid.labelled(spark, sf)[0]))


_POINTS = "f AS (SELECT segment_id, floor(m0) AS x, floor(m1) AS y FROM m)"


def _points(spark, sf):
    return _means(spark, sf).select("segment_id", F.floor("mean_band_0").cast("double").alias("x"), F.floor("mean_band_1").cast("double").alias("y"))


@query(f"WITH {PX}, {_MEANS}, {_POINTS}, s AS (SELECT avg(x) AS ax, stddev_pop(x) AS sx, avg(y) AS ay, stddev_pop(y) AS sy FROM f) SELECT segment_id, round((x - ax) / sx, 6) AS x, round((y - ay) / sy, 6) AS y FROM f, s")
def standardize(spark, sf):
    return rounded(unsupervised.standardized(_points(spark, sf)))


@query(f"WITH {PX}, {_MEANS}, {_POINTS}, d AS (SELECT a.segment_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM f a, f b), k AS (SELECT segment_id, d, row_number() OVER (PARTITION BY segment_id ORDER BY d) AS k FROM d) SELECT round(median(d), 6) AS eps FROM k WHERE k = 5")
def auto_eps(spark, sf):
    return rounded(unsupervised.auto_eps(_points(spark, sf), 5))


@query(f"WITH {PX}, {_MEANS}, {_POINTS} SELECT a.segment_id, count(*) AS n_neighbors FROM f a, f b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144 GROUP BY a.segment_id HAVING count(*) >= 5")
def dbscan_core_points(spark, sf):
    return unsupervised.core_points(_points(spark, sf), 12.0, 5)


@query(f"""WITH RECURSIVE {PX}, {_MEANS}, {_POINTS}, near AS (SELECT a.segment_id AS a, b.segment_id AS b FROM f a, f b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
links AS (SELECT a, b FROM near JOIN core x ON a = x.id JOIN core y ON b = y.id),
reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
part AS (SELECT id, min(r) AS c FROM reach GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY c) AS k FROM part)
SELECT f.segment_id, CAST(coalesce((SELECT k FROM num WHERE num.id = f.segment_id), (SELECT min(k) FROM near JOIN num ON near.a = num.id WHERE near.b = f.segment_id), 0) AS INTEGER) AS cluster FROM f""")
def dbscan(spark, sf):
    return unsupervised.dbscan(_points(spark, sf), 12.0, 5)


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (n_nationkey % 7 <> 0) AS BIGINT) AS succeeded, CAST(count(*) FILTER (n_nationkey % 7 = 0) AS BIGINT) AS failed, CAST(sum(n_nationkey * 3) AS BIGINT) AS total_segments, round(sum(n_nationkey * 0.25::DOUBLE), 2) AS total_duration_s, CAST(count(*) FILTER (n_nationkey % 7 = 0) AS INTEGER) AS n_errors FROM nation")
def batch_summary_query(spark, sf):
    out = batch_summary(grid.runs(spark, sf))
    return out.select("total", "succeeded", "failed", "total_segments", "total_duration_s", F.size("errors").alias("n_errors"))


@query()
def kmeans(spark, sf):
    return unsupervised.UnsupervisedClassifier("kmeans", n_clusters=5).fit(_points(spark, sf)).predict(_points(spark, sf))


@query()
def gmm(spark, sf):
    return rounded(unsupervised.UnsupervisedClassifier("gmm", n_components=3).fit(_points(spark, sf)).predict_proba(_points(spark, sf)))


def _supervised(algorithm: str, **params) -> Query:
    def run(spark, sf):
        table = grid.vectors(spark, sf).drop("label")
        true = grid.labelled(spark, sf)[0]
        return supervised.SupervisedClassifier(algorithm, **params).fit(table, true).predict(table)

    run.__name__ = algorithm
    return query()(run)


_supervised("random_forest")
_supervised("gradient_boosting", n_estimators=3, max_depth=3)
_supervised("svm")


@query()
def feature_importance(spark, sf):
    table = grid.vectors(spark, sf).drop("label")
    return rounded(supervised.SupervisedClassifier("random_forest").fit(table, grid.labelled(spark, sf)[0]).feature_importance())


@query()
def cross_validate(spark, sf):
    table = grid.vectors(spark, sf).drop("label")
    found = supervised.cross_validate(supervised.SupervisedClassifier("random_forest"), table, grid.labelled(spark, sf)[0])
    return spark.createDataFrame([(found["mean_accuracy"], found["std_accuracy"], found["fold_scores"])], "mean_accuracy double, std_accuracy double, fold_scores array<double>")


@query("SELECT segment_id, class_label, CAST(floor((k - 1) * 5 / n) AS INTEGER) AS fold FROM (SELECT CAST(vec_id + 1 AS INTEGER) AS segment_id, 'c' || label AS class_label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def stratified_folds(spark, sf):
    return supervised.stratified_folds(grid.labelled(spark, sf)[0])


def _segmenter(method: str, **params) -> Query:
    def run(spark, sf):
        px = grid.pixels(spark, sf).drop("segment_id")
        return segment.segment_tiled(px, method, tile_size=64, overlap=8, **params).select("row", "col", "segment_id")

    run.__name__ = f"segment_{method}"
    return query()(run)


_segmenter("slic", n_segments=60)
_segmenter("felzenszwalb", scale=100.0, min_size=20)
_segmenter("shepherd", num_clusters=12, min_n_pxls=20)
_segmenter("watershed", markers=60, min_distance=4)


# area and bounds of a segment's polygons follow from its pixels
@query(f"WITH {SHEARED}, s AS (SELECT * FROM px WHERE segment_id > 0) SELECT segment_id, CAST(count(*) AS DOUBLE) AS area, CAST(min(col) AS DOUBLE) AS min_x, CAST(max(col) + 1 AS DOUBLE) AS max_x, CAST(-max(\"row\") - 1 AS DOUBLE) AS min_y, CAST(-min(\"row\") AS DOUBLE) AS max_y FROM s GROUP BY segment_id")
def vectorized(spark, sf):
    polygons = vectorize.vectorize(grid.pixels(spark, sf, sheared=True), grid.TRANSFORM)
    return vectorize.measured(polygons).select("segment_id", "area", "min_x", "max_x", "min_y", "max_y")


@query()
def pipeline_e2e(spark, sf):
    """From pixels to classes: segments, features and clusters."""
    steps = [("segment", "slic", {"n_segments": 500}), ("extract", ["spectral", "geometry"], {}), ("classify", "kmeans", {"n_clusters": 5})]
    return Pipeline(steps).run(grid.pixels(spark, sf).drop("segment_id")).predictions


@query(f"WITH {PX} SELECT segment_id FROM px WHERE \"row\" = 7 AND col = 23 AND segment_id > 0")
def segment_at(spark, sf):
    return samples.segment_at(grid.pixels(spark, sf), 23.5, -7.5, grid.TRANSFORM)


@query(f"WITH {PX}, k AS (SELECT 'k' || (segment_id % 3) AS class_label FROM (SELECT DISTINCT segment_id FROM px WHERE segment_id > 0)) SELECT class_label, count(*) AS n_samples FROM k GROUP BY 1")
def sample_count(spark, sf):
    ids = labels.segment_sizes(grid.pixels(spark, sf)).select("segment_id", F.concat(F.lit("k"), (F.col("segment_id") % 3).cast("string")).alias("class_label"))
    return explore.sample_count(ids)

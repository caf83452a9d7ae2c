"""Clustering of feature tables: k-means and Gaussian mixtures by MLlib, DBSCAN by joins."""

from __future__ import annotations

import functools
import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import checkpointed, keys

NOISE = 0
ALGORITHMS = ("kmeans", "gmm", "dbscan")
#: name: (default, type, meaning) of each algorithm's parameters.
SCHEMA = {
    "kmeans": {"n_clusters": (8, "integer", "Clusters"), "n_init": (10, "integer", "Runs, of which the best counts"), "max_iter": (300, "integer", "Iterations of a run"), "random_state": (42, "integer", "Seed")},
    "gmm": {"n_components": (8, "integer", "Components"), "n_init": (3, "integer", "Runs, of which the best counts"), "max_iter": (100, "integer", "Iterations of a run"), "random_state": (42, "integer", "Seed")},
    "dbscan": {"eps": (0.0, "number", "Distance of neighbours; 0 finds one"), "min_samples": (5, "integer", "Neighbours of a core point, itself included")},
}


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("image_id", "segment_id")]


def assembled(features: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="error").transform(features.select(*keys(features), *(F.col(c).cast("double").alias(c) for c in names))).select(*keys(features), "_x")


def standardized(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each feature less its mean, over its deviation (of the population; 0 counts as 1)."""
    names = names or feature_columns(features)
    stats = features.agg(*(f(F.col(c).cast("double")).alias(f"_{s}_{c}") for c in names for s, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = features.join(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.select(*keys(features), *(((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(c) for c in names))


def _rows(features: DataFrame, names: list[str]) -> DataFrame:
    """segment_id, x: computed once, as places and what is found for them both start from it."""
    return checkpointed(features.select("segment_id", F.array(*[F.col(c).cast("double") for c in names]).alias("x")))


def _places(rows: DataFrame) -> DataFrame:
    """place (its least segment_id), x, n: the rows of equal features as one, so that copies are never held against each
    other."""
    return checkpointed(rows.groupBy("x").agg(F.min("segment_id").alias("place"), F.count(F.lit(1)).alias("n")))


def squared_distance(a: Column, b: Column, size: int) -> Column:
    if size > 8:  # too long to be compiled
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(size)), F.lit(0.0))


#: Places of a block, about, two of which a task compares.
BLOCK = 2000
#: Places of a block that are held against another block at a time.
AT_ONCE = 250


def _least(mine: pd.DataFrame, theirs: pd.DataFrame, k: int) -> pd.DataFrame:
    """place, near: the k places of theirs that are next to each of mine, with their rows (k at most)."""
    if mine.empty or theirs.empty:
        return pd.DataFrame({"place": [], "near": []})
    a, b, n = np.stack(mine["x"].to_list()), np.stack(theirs["x"].to_list()), np.minimum(theirs["n"].to_numpy(), k)
    near, most = [], min(k, len(b))
    for low in range(0, len(a), AT_ONCE):
        d = np.zeros((len(a[low : low + AT_ONCE]), len(b)))
        for i in range(a.shape[1]):
            d += (a[low : low + AT_ONCE, i, None] - b[None, :, i]) ** 2
        which = np.argpartition(d, most - 1, axis=1)[:, :most]
        near += [list(zip(v, w, strict=True)) for v, w in zip(np.take_along_axis(d, which, 1).tolist(), n[which].tolist(), strict=True)]
    return pd.DataFrame({"place": mine["place"].to_numpy(), "near": near})


def _kth(near: Column, k: int) -> Column:
    """The squared distance of the k-th row of near; without so many, null."""
    step = lambda s, v: F.struct((s["n"] + v["n"]).alias("n"), F.when((s["n"] < k) & (s["n"] + v["n"] >= k), v["d"]).otherwise(s["d"]).alias("d"))
    return F.aggregate(F.array_sort(near), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d")), step)["d"]


def _kth_distances(rows: DataFrame, places: DataFrame, k: int, size: int) -> DataFrame:
    blocks = max(1, -(-places.count() // BLOCK))
    own = checkpointed(places.repartitionByRange(blocks, "x").withColumn("own", F.spark_partition_id()))
    schema = "place int, near array<struct<d: double, n: bigint>>"
    within = checkpointed(own.groupBy("own").applyInPandas(lambda pdf: _least(pdf, pdf, k), schema))
    # a block is asked by the places that may lie nearer to its box than to the k-th row of their own block
    bounds = [f(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])).alias(f"{name}{i}") for i in range(size) for name, f in (("low", F.min), ("high", F.max))]
    boxes = own.groupBy(F.col("own").alias("other")).agg(*bounds)
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"low{i}") - F.col("x")[i], F.col("x")[i] - F.col(f"high{i}"))
    far = sum((gap(i) * gap(i) for i in range(size)), F.lit(0.0))
    bound = within.select("place", _kth("near", k).alias("bound"))
    met = own.join(bound, "place").join(F.broadcast(boxes), (F.col("own") != F.col("other")) & (F.col("bound").isNull() | (far <= F.col("bound"))))  # a row for each block
    asks = checkpointed(met.select("place", "x", "own", "other"))
    asked = asks.select("own", "other").distinct()
    others = own.select(F.col("own").alias("theirs"), F.col("x").alias("y"), F.col("n").alias("m")).join(asked.toDF("mine", "theirs"), "theirs")
    beyond = asks.groupBy("own", "other").cogroup(others.groupBy("mine", "theirs")).applyInPandas(lambda mine, theirs: _least(mine, theirs.rename(columns={"y": "x", "m": "n"}), k), schema)
    found = within.union(beyond).groupBy("place").agg(F.sqrt(_kth(F.flatten(F.collect_list("near")), k)).alias("distance"))
    return rows.join(places.join(found, "place").select("x", "distance"), "x").select("segment_id", "distance")


def kth_distances(features: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """segment_id, distance to its k-th nearest row, itself being the first.

    Rows of equal features are one place. Places are cut into blocks of about BLOCK in the order of their features; each
    is held against its own block, and then only against those whose box is as near as the k-th row found there. No pairs
    are emitted, and no group grows with the table.
    """
    names = names or feature_columns(features)
    rows = _rows(features, names)
    return _kth_distances(rows, _places(rows), k, len(names))


def auto_eps(features: DataFrame, min_samples: int = 5, names: list[str] | None = None) -> DataFrame:
    """eps: the median distance to the min_samples-th nearest row, at most all but one."""
    names = names or feature_columns(features)
    rows = _rows(features, names)
    k = max(1, min(min_samples, rows.count() - 1))
    return _kth_distances(rows, _places(rows), k, len(names)).agg(F.median("distance").alias("eps"))


def _neighbours(left: DataFrame, right: DataFrame, eps: float, size: int) -> DataFrame:
    """a, b, n (rows of b): places of left and right at most eps apart. They meet in the cells of a grid over the first
    two features (each one in its own and the cells around it), so that only those nearby are compared."""
    cell = [F.floor(F.col("x")[i] / eps) if eps > 0 else F.col("x")[i] for i in range(min(2, size))]
    around = right.select(F.col("place").alias("b"), F.col("x").alias("y"), "n", *[c.alias(f"g{i}") for i, c in enumerate(cell)])
    if eps > 0:
        for i in range(len(cell)):
            around = around.withColumn(f"g{i}", F.explode(F.sequence(F.col(f"g{i}") - 1, F.col(f"g{i}") + 1)))
    own = left.select(F.col("place").alias("a"), "x", *[c.alias(f"g{i}") for i, c in enumerate(cell)])
    met = own.join(around, [f"g{i}" for i in range(len(cell))])
    return met.where(squared_distance(F.col("x"), F.col("y"), size) <= eps * eps).select("a", "b", "n")


#: Places of a leaf, into which a block is cut where it is compared.
LEAF = 32
#: Features in whose order places are cut into blocks, and bits of each within a cell.
LEADING, BITS = 3, 10
#: Pairs of blocks that a task compares, about, where there are more than four to a core.
BLOCK_PAIRS = 64


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """The positions of x in groups of at most LEAF, halved along their widest feature."""
    uncut, out = [np.arange(len(x))], []
    while uncut:
        at = uncut.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        part = x[at]
        order = np.argpartition(part[:, np.argmax(part.max(0) - part.min(0))], len(at) // 2)
        uncut += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all a and b, summed as in squared_distance."""
    d = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d += (a[:, None, i] - b[None, :, i]) ** 2
    return d


def _rows_within(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of b (m to a place) within the limit of each a, and of a (n to a place) of each b. Leaves whose boxes lie
    wholly within it are counted by their sums, and only those on its edge place by place. Bounds are rounded as
    distances are, in the same order, so they hold for rounded distances too."""
    of_a, of_b = _leaves(a), _leaves(b)
    low, high = (np.array([f(a[at], axis=0) for at in of_a]) for f in (np.min, np.max))
    to_low, to_high = (np.array([f(b[at], axis=0) for at in of_b]) for f in (np.min, np.max))
    least, most = np.zeros((len(of_a), len(of_b))), np.zeros((len(of_a), len(of_b)))
    for i in range(a.shape[1]):
        up, down = low[:, None, i] - to_high[None, :, i], to_low[None, :, i] - high[:, None, i]
        least += np.maximum(0, np.maximum(up, down)) ** 2
        most += np.maximum(np.abs(up), np.abs(down)) ** 2
    whole = most <= limit
    edge = (least <= limit) & ~whole
    found_a, found_b = np.zeros(len(a)), np.zeros(len(b))
    for at, rows in zip(of_a, whole @ np.array([m[at].sum() for at in of_b]), strict=True):
        found_a[at] = rows
    for at, rows in zip(of_b, np.array([n[at].sum() for at in of_a]) @ whole, strict=True):
        found_b[at] = rows
    for at, met in zip(of_a, edge, strict=True):
        if met.any():
            to = np.concatenate([of_b[j] for j in np.flatnonzero(met)])
            near = (_between(a[at], b[to]) <= limit).astype(float)
            found_a[at] += near @ m[to]
            found_b[to] += n[at] @ near
    return found_a, found_b


def _core_places(places: DataFrame, eps: float, min_samples: int, size: int) -> DataFrame:
    """place, n_neighbors of the places with at least min_samples rows within eps.

    Places are cut into compact blocks of about BLOCK. Blocks wholly within eps of each other are counted by their sums;
    only pairs of blocks on its edge are compared, two blocks at a time. No pairs of places are emitted. A place with a
    feature that is not a finite number has no neighbours.
    """
    limit = float(eps * eps)
    x = [F.col("x")[i] for i in range(size)]
    finite = places.where(functools.reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in x]))
    # in the order of cells of side eps, and within a cell along a curve that takes a bit of each feature in turn
    scaled = [c / eps if eps > 0 else c for c in x[:LEADING]]
    inner = [F.floor(F.least(F.greatest((c - F.floor(c)) * 2**BITS, F.lit(0.0)), F.lit(2.0**BITS - 1))).cast("int") for c in scaled]
    curve = sum((F.shiftleft(c.bitwiseAND(1 << k), k * (len(inner) - 1) + i) for k in range(BITS) for i, c in enumerate(inner)), F.lit(0))
    blocks = max(1, -(-finite.count() // BLOCK))
    own = checkpointed(finite.repartitionByRange(blocks, *map(F.floor, scaled), curve, "x").withColumn("own", F.spark_partition_id()))
    boxes = own.groupBy("own").agg(F.sum("n").alias("rows"), *(f(c).alias(f"{name}{i}") for i, c in enumerate(x) for name, f in (("low", F.min), ("high", F.max))))
    others = boxes.select(F.col("own").alias("other"), F.col("rows").alias("other_rows"), *(F.col(f"{name}{i}").alias(f"to_{name}{i}") for i in range(size) for name in ("low", "high")))
    gaps = [(F.col(f"low{i}") - F.col(f"to_high{i}"), F.col(f"to_low{i}") - F.col(f"high{i}")) for i in range(size)]
    square = lambda c: c * c
    least = sum((square(F.greatest(F.lit(0.0), *g)) for g in gaps), F.lit(0.0))
    most = sum((square(F.greatest(*map(F.abs, g))) for g in gaps), F.lit(0.0))
    met = boxes.join(F.broadcast(others), (F.col("own") <= F.col("other")) & (least <= limit))  # a row for each block
    pairs = checkpointed(met.select("own", "other", "rows", "other_rows", (most <= limit).alias("whole")))
    whole = pairs.where("whole")
    sums = whole.select("own", F.col("other_rows").alias("rows")).union(whole.where("own <> other").select("other", "rows")).groupBy("own").agg(F.sum("rows").alias("n_neighbors"))
    edge = pairs.where("NOT whole").select("own", "other")
    cores, n = places.sparkSession.sparkContext.defaultParallelism, edge.count()
    tasks = max(1, min(n, max(4 * cores, n // BLOCK_PAIRS)))  # set, as AQE would merge them by their few bytes

    def compared(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = _rows_within(np.stack(mine["x"].to_list()), mine["n"].to_numpy(float), np.stack(theirs["y"].to_list()), theirs["m"].to_numpy(float), limit)
        sides = list(zip((mine["place"], theirs["b"]), found, strict=True))[: 1 if key[0] == key[1] else 2]
        return pd.concat([pd.DataFrame({"place": place, "n_neighbors": rows.astype("int64")}) for place, rows in sides])

    mine = own.join(edge, "own").repartition(tasks, "own", "other")
    theirs = own.select(F.col("own").alias("theirs"), F.col("place").alias("b"), F.col("x").alias("y"), F.col("n").alias("m")).join(edge.toDF("mine", "theirs"), "theirs").repartition(tasks, "mine", "theirs")
    counted = mine.groupBy("own", "other").cogroup(theirs.groupBy("mine", "theirs")).applyInPandas(compared, f"place {places.schema['place'].dataType.simpleString()}, n_neighbors bigint")
    near = counted.union(own.join(sums, "own").select("place", "n_neighbors"))
    return near.groupBy("place").agg(F.sum("n_neighbors").alias("n_neighbors")).where(F.col("n_neighbors") >= min_samples)


def core_points(features: DataFrame, eps: float, min_samples: int = 5, names: list[str] | None = None) -> DataFrame:
    """segment_id, n_neighbors of the rows with at least min_samples rows within eps, themselves included."""
    names = names or feature_columns(features)
    rows = _rows(features, names)
    places = _places(rows)
    core = places.join(_core_places(places, eps, min_samples, len(names)), "place").select("x", "n_neighbors")
    return rows.join(core, "x").select("segment_id", "n_neighbors")


def connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component (the least id reached) of every vertex; edges (a, b) go both ways.

    Labels are taken from neighbours, then from the label's own label, until none changes; each round is cut off by
    a checkpoint, so the plan doesn't grow.
    """
    both = checkpointed(edges.where("a <> b"))
    labels = checkpointed(vertices.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("least"))
        nearer = labels.join(seen, "id", "left").select("id", F.least("component", F.coalesce("least", "component")).alias("next"), F.col("component").alias("before"))
        jump = nearer.select(F.col("id").alias("next"), F.col("next").alias("far"))
        after = nearer.join(jump, "next", "left").select("id", F.coalesce("far", "next").alias("component"), "before")
        after = checkpointed(after)
        if not after.where("component <> before").limit(1).count():
            return after.select("id", "component")
        labels = after.select("id", "component")


def _hubs(core: DataFrame, eps: float, size: int) -> DataFrame:
    """core with hub, the least place of its cell. Cells are so small that all their places are within eps of each
    other; a place too far out for cells to be told apart exactly is its own hub."""
    side = eps / math.sqrt(size) * (1 - 1e-6)
    if side <= 0:
        return core.withColumn("hub", F.col("place"))
    scaled = [F.col("x")[i] / side for i in range(size)]
    exact = functools.reduce(lambda a, b: a & b, [F.abs(c) < 2**30 for c in scaled])
    cell = F.when(exact, F.array(*map(F.floor, scaled)))
    celled = core.withColumn("cell", cell)
    hubs = celled.where("cell is not null").groupBy("cell").agg(F.min("place").alias("hub"))
    return celled.join(hubs, "cell", "left").select(*core.columns, F.coalesce("hub", "place").alias("hub"))


def dbscan(features: DataFrame, eps: float, min_samples: int = 5, names: list[str] | None = None) -> DataFrame:
    """segment_id, cluster: 1 to k by the least id of their core rows; 0 for noise. A row that several clusters
    reach belongs to the first of them. Rows of equal features are one place, and the core places of a small cell are
    one vertex, so that links don't grow with the rows of a cluster."""
    names = names or feature_columns(features)
    size = len(names)
    rows = _rows(features, names)
    places = _places(rows)
    core = checkpointed(_hubs(places.join(_core_places(places, eps, min_samples, size).select("place"), "place"), eps, size))
    hub_of = core.select("place", "hub")
    links = _neighbours(core, core, eps, size).join(hub_of.toDF("a", "from"), "a").join(hub_of.toDF("b", "to"), "b").where(F.col("from") < F.col("to"))
    edges = links.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()
    parts = connected(edges.union(edges.select("b", "a")), core.select(F.col("hub").alias("id")).distinct())
    numbers = parts.select("component").distinct().withColumn("number", F.row_number().over(Window.orderBy("component")))
    of_core = checkpointed(core.join(parts.join(numbers, "component").select(F.col("id").alias("hub"), "number"), "hub").select("place", "x", "n", "number"))
    rest = places.join(of_core.select("place"), "place", "left_anti")
    reached = _neighbours(of_core, rest, eps, size).join(of_core.select(F.col("place").alias("a"), "number"), "a").groupBy(F.col("b").alias("place")).agg(F.min("number").alias("number"))
    found = of_core.select("x", "number").union(rest.join(reached, "place").select("x", "number"))
    return rows.join(found, "x", "left").select("segment_id", F.coalesce("number", F.lit(NOISE)).alias("cluster"))


#: Fits whose jobs run at the same time: those of one fit are small, and wait for each other.
FITS_AT_ONCE = 5
#: Rows that a task of a fit takes at least.
ROWS_OF_TASK = 20_000


class UnsupervisedClassifier:
    """kmeans, gmm or dbscan. Clusters are numbered from 1 by their centres' first feature; k-means and mixtures take
    the features as they are, DBSCAN standardizes them."""

    def __init__(self, algorithm: str = "kmeans", **params) -> None:
        if algorithm not in ALGORITHMS:
            raise ValueError(f"Unknown algorithm: {algorithm!r}. Available: {ALGORITHMS}")
        if algorithm == "gmm" and "n_clusters" in params:
            params = {**params, "n_components": params["n_clusters"]}
            params.pop("n_clusters")
        if unknown := sorted(set(params) - set(SCHEMA[algorithm])):
            raise ValueError(f"Unknown parameter of {algorithm}: {unknown[0]!r}")
        self.algorithm, self.params = algorithm, {k: v[0] for k, v in SCHEMA[algorithm].items()} | params
        self.feature_names: list[str] | None = None
        self.model = None
        self.order: list[int] = []
        self.labels: DataFrame | None = None

    def get_params(self) -> dict:
        return {"algorithm": self.algorithm, **self.params}

    @staticmethod
    def get_param_schema(algorithm: str) -> dict:
        return {"type": "object", "properties": {k: {"type": t, "default": d, "description": s} for k, (d, t, s) in SCHEMA[algorithm].items()}}

    def fit(self, features: DataFrame, labels: DataFrame | None = None) -> UnsupervisedClassifier:
        self.feature_names = feature_columns(features)
        p = self.params
        if self.algorithm == "dbscan":
            scaled = standardized(features)
            eps = p["eps"] or auto_eps(scaled, p["min_samples"]).first()["eps"]
            self.labels = dbscan(scaled, eps, p["min_samples"])
            return self
        k = p["n_clusters"] if self.algorithm == "kmeans" else p["n_components"]
        rows = assembled(features, self.feature_names).persist()
        try:
            if (n := rows.count()) < k:
                raise ValueError(f"n_samples={n} should be >= n_clusters={k}")
            # every iteration is a job with a task for each partition: small tables need few
            few = rows.coalesce(max(1, n // ROWS_OF_TASK))

            def run(i: int) -> tuple:
                if self.algorithm == "kmeans":
                    m = KMeans(k=k, maxIter=p["max_iter"], seed=p["random_state"] + i, featuresCol="_x", predictionCol="_p", tol=1e-4).fit(few)
                    return m.summary.trainingCost, i, m, [c[0] for c in m.clusterCenters()]
                m = GaussianMixture(k=k, maxIter=p["max_iter"], seed=p["random_state"] + i, featuresCol="_x", predictionCol="_p", probabilityCol="_q").fit(few)
                return -m.summary.logLikelihood, i, m, [r["mean"][0] for r in m.gaussiansDF.collect()]

            with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
                runs = list(pool.map(run, range(max(1, p["n_init"]))))
            _, _, self.model, first = min(runs, key=lambda r: r[:2])
            self.order = [sorted(range(len(first)), key=first.__getitem__).index(j) for j in range(len(first))]
        finally:
            rows.unpersist()
        return self

    def _scored(self, features: DataFrame) -> DataFrame:
        if self.feature_names is None:
            raise RuntimeError("Classifier has not been fitted")
        return self.model.transform(assembled(features, self.feature_names))

    def predict(self, features: DataFrame) -> DataFrame:
        if self.algorithm == "dbscan":
            if self.feature_names is None:
                raise RuntimeError("Classifier has not been fitted")
            # DBSCAN has no rule for rows that it wasn't fitted on
            return features.select("segment_id").join(self.labels, "segment_id", "left").select("segment_id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
        number = F.element_at(F.array(*[F.lit(n + 1) for n in self.order]), F.col("_p") + 1)
        return self._scored(features).select(*keys(features), number.alias("cluster"))

    def predict_proba(self, features: DataFrame) -> DataFrame | None:
        """prob_cluster_1 and so on, of mixtures; else None."""
        if self.algorithm != "gmm":
            return None
        q = vector_to_array(F.col("_q"))
        return self._scored(features).select(*keys(features), *(q[j].alias(f"prob_cluster_{n + 1}") for n, j in sorted((n, j) for j, n in enumerate(self.order))))

    def save(self, path: str) -> None:
        state = {"kind": "unsupervised", "algorithm": self.algorithm, "params": self.params, "features": self.feature_names, "order": self.order}
        from ..sources.tables import write_text

        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        write_text(spark, f"{path}/state.json", json.dumps(state))
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        if self.labels is not None:
            self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> UnsupervisedClassifier:
        from pyspark.ml.clustering import GaussianMixtureModel, KMeansModel
        from pyspark.sql import SparkSession

        from ..sources.tables import read_text

        spark = SparkSession.getActiveSession()
        state = json.loads(read_text(spark, f"{path}/state.json"))
        if not isinstance(state, dict) or state.get("kind") != "unsupervised":
            raise TypeError("Not a saved clustering")
        out = cls(state["algorithm"], **state["params"])
        out.feature_names, out.order = state["features"], state["order"]
        if out.algorithm == "dbscan":
            out.labels = spark.read.parquet(f"{path}/labels")
        else:
            out.model = (KMeansModel if out.algorithm == "kmeans" else GaussianMixtureModel).load(f"{path}/model")
        return out

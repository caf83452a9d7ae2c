"""Operators on small grids with known results, and against brute force in numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.columns import as_uint8, grid_row_col, membership, scaled_10000
from terralith.operators import accuracy, change, context, explore, features, fuzzy, geometry, hierarchy, kernels, labels, samples, segment, spectral, supervised, texture, unsupervised, vectorize

RNG = np.random.RandomState(42)


def relation(spark, label, *bands, image_id=None):
    h, w = label.shape
    rows = [(r, c, int(label[r, c]), *(float(b[r, c]) for b in bands)) for r in range(h) for c in range(w)]
    out = spark.createDataFrame(rows, "row int, col int, segment_id int" + "".join(f", b{k} double" for k in range(len(bands))))
    return out if image_id is None else out.withColumn("image_id", F.lit(image_id))


def quadrants(n=20):
    label = np.ones((n, n), int)
    label[:, n // 2 :] += 1
    label[n // 2 :] += 2
    return label


def by_id(df):
    return {r["segment_id"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def four(spark):
    label = quadrants()
    bands = [np.where(label == 1, 0.15, np.where(label == 2, 0.4, 0.1)) + RNG.normal(0, 0.02, label.shape) for _ in range(4)]
    return label, bands, relation(spark, label, *bands).cache()


def test_labels(spark, four):
    _, _, px = four
    assert labels.count_segments(px).first()[0] == 4
    assert by_id(labels.segment_sizes(px))[1]["size"] == 100
    assert by_id(labels.segment_slices(px))[1] == {"segment_id": 1, "row_start": 0, "row_stop": 10, "col_start": 0, "col_stop": 10}
    sparse = relation(spark, np.array([[0, 5], [10, 5], [200_000, 70_000]]))
    assert {(r["row"], r["col"]): r["segment_id"] for r in labels.relabel_sequential(sparse).collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 1, (2, 0): 4, (2, 1): 3}
    assert labels.mask_labels(px, F.col("row") < 10).where("segment_id = 0").count() == 200


def test_spectral(spark, four):
    label, bands, px = four
    got = by_id(spectral.spectral(px, {"red": 0, "green": 1, "blue": 2, "nir": 3}))
    assert set(got[1]) == {"segment_id", *spectral.feature_names(4, {"red": 0, "green": 1, "blue": 2, "nir": 3})}
    for k in range(1, 5):
        own = bands[0][label == k]
        assert got[k]["mean_red"] == pytest.approx(own.mean()) and got[k]["std_red"] == pytest.approx(own.std()) and got[k]["median_red"] == pytest.approx(np.median(own))
        red, nir = own.mean(), bands[3][label == k].mean()
        assert got[k]["ndvi"] == pytest.approx((nir - red) / (nir + red)) and got[k]["range_red"] == pytest.approx(np.ptp(own))
    assert spectral.named_bands(3, ["a"]) == ["a", "band_1", "band_2"] and spectral.named_bands(2, {"x": 1}) == ["band_0", "x"]
    assert "ndvi" not in spectral.spectral(px, ["red", "green", "blue", "nir"]).columns
    flat = np.full((4, 4), 5.0)
    flat[0, 0] = -9999
    one = relation(spark, np.ones((4, 4), int), flat)
    assert by_id(spectral.spectral(one, nodata=-9999))[1]["mean_band_0"] == 5.0
    none = by_id(spectral.spectral(relation(spark, np.ones((2, 2), int), np.full((2, 2), -9999.0)), nodata=-9999))
    assert none[1]["mean_band_0"] is None and none[1]["min_band_0"] is None
    zero = by_id(spectral.spectral(relation(spark, np.ones((1, 2), int), np.zeros((1, 2)), np.zeros((1, 2))), {"red": 0, "nir": 1}))
    assert zero[1]["ndvi"] == 0


def test_geometry(spark):
    label = np.zeros((9, 14), int)
    label[2:7, 2:12] = 1
    label[0, 0] = 2
    got = by_id(geometry.geometry(relation(spark, label), pixel_size=10))
    assert got[1]["perimeter"] == pytest.approx(260) and got[1]["area"] == 5000 and got[1]["area_px"] == 50 and got[1]["solidity"] == 1
    assert got[1]["rectangularity"] == 1 and got[1]["major_axis_length"] == pytest.approx(4 * math.sqrt(99 / 12)) and got[1]["minor_axis_length"] == pytest.approx(4 * math.sqrt(24 / 12))
    assert abs(got[1]["orientation"]) == pytest.approx(math.pi / 2) and got[1]["elongation"] == pytest.approx(math.sqrt(99 / 24))
    assert got[2]["perimeter"] == got[2]["compactness"] == got[2]["elongation"] == got[2]["eccentricity"] == 0 and got[2]["area_px"] == 1
    notch = np.ones((6, 6), int)
    notch[:3, 3:] = 0
    assert 0.7 < by_id(geometry.solidity(relation(spark, notch)))[1]["solidity"] < 1
    tilted = np.eye(7, dtype=int)
    assert by_id(geometry.moments(relation(spark, tilted)))[1]["eccentricity"] == 1


def brute_texture(gray, label, k, levels):
    out = defaultdict(list)
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        m = np.zeros((levels, levels))
        for r, c in zip(*np.nonzero(label == k), strict=True):
            y, x = r + dr, c + dc
            if 0 <= y < label.shape[0] and 0 <= x < label.shape[1] and label[y, x] == k:
                m[gray[r, c], gray[y, x]] += 1
                m[gray[y, x], gray[r, c]] += 1
        p = m / (m.sum() or 1)
        i, j = np.mgrid[:levels, :levels]
        mean = (p * i).sum()
        deviation = (p * (i - mean) ** 2).sum()
        out["contrast"].append((p * (i - j) ** 2).sum())
        out["dissimilarity"].append((p * abs(i - j)).sum())
        out["homogeneity"].append((p / (1 + (i - j) ** 2)).sum())
        out["energy"].append(math.sqrt((p**2).sum()))
        out["correlation"].append(1.0 if deviation < 1e-15 else (p * (i - mean) * (j - mean)).sum() / deviation)
    return {n: np.mean(v) for n, v in out.items()}


def test_texture_against_numpy(spark):
    label = np.repeat(np.repeat(np.arange(1, 7).reshape(2, 3), 5, 0), 4, 1)
    label[4, :3] = 0
    label[9, 11], label[0, :9] = 7, 8
    band = RNG.uniform(0, 1, label.shape)
    px = relation(spark, label, band, np.full(label.shape, 0.5))
    got = by_id(texture.texture(px, levels=8))
    gray = np.floor((band - band.min()) / (band.max() - band.min()) * 7).astype(int)
    for k in range(1, 9):
        if (label == k).sum() < 4:
            assert all(v == 0 for n, v in got[k].items() if n != "segment_id")
            continue
        for name, value in brute_texture(gray, label, k, 8).items():
            assert got[k][f"glcm_{name}_b0"] == pytest.approx(value), (k, name)
        assert got[k]["glcm_contrast_b1"] == 0


def test_context_against_numpy(spark, four):
    label, bands, px = four
    got = by_id(context.context(px))
    means = {k: np.array([b[label == k].mean() for b in bands]) for k in range(1, 5)}
    for k, near in {1: (2, 3), 2: (1, 4), 3: (1, 4), 4: (2, 3)}.items():
        other = np.array([means[x] for x in near])
        assert got[k]["n_neighbors"] == 2
        assert got[k]["mean_neighbor_brightness"] == pytest.approx(other.mean()) and got[k]["std_neighbor_brightness"] == pytest.approx(other.std(), abs=1e-7)
        assert got[k]["border_contrast"] == pytest.approx(np.abs(other - means[k]).mean())
    lone = by_id(context.context(relation(spark, np.array([[1, 0, 2]]), np.ones((1, 3)))))
    assert all(lone[1][n] == 0 for n in lone[1] if n != "segment_id")


def test_extract(spark, four):
    _, _, px = four
    whole = features.extract(px, texture_levels=8)
    assert whole.count() == 4 and {"mean_band_0", "area", "glcm_energy_b3", "n_neighbors"} <= set(whole.columns)
    assert features.extract(px, []).columns == ["segment_id"]
    told = []
    features.extract(px, ["Spectral", "geometry"], progress=told.append)
    assert told == [50, 100]
    with pytest.raises(ValueError):
        features.extract(px, ["colour"])


def test_images_are_kept_apart(spark):
    label = quadrants(6)
    both = relation(spark, label, label * 1.0, image_id="a").unionByName(relation(spark, label * 2, label * 3.0, image_id="b"))
    got = {(r["image_id"], r["segment_id"]): r for r in features.extract(both, ["spectral", "context", "texture"], texture_levels=4).collect()}
    assert len(got) == 8 and got["b", 8]["mean_band_0"] == 12 and got["a", 1]["n_neighbors"] == 2
    assert {(r["image_id"], r["n_segments"]) for r in labels.count_segments(both).collect()} == {("a", 4), ("b", 4)}


def test_hierarchy(spark):
    fine = relation(spark, np.arange(1, 17).reshape(4, 4))
    coarse = relation(spark, np.array([[1, 1, 2, 2]] * 4))
    got = {r["segment_id"]: r for r in hierarchy.cross_scale_features(fine, coarse).collect()}
    assert got[1]["parent_id"] == 1 and got[3]["parent_id"] == 2 and got[1]["area_ratio"] == 1 / 8 and got[1]["n_siblings"] == 8
    tied = hierarchy.parent_map(relation(spark, np.ones((1, 4), int)), relation(spark, np.array([[0, 2, 1, 0]])))
    assert tied.first()["parent_id"] == 1
    assert hierarchy.log_spaced(50, 5000, 3) == [50, 500, 5000]


def test_change(spark):
    one = spark.createDataFrame([(1, 0.2, 0.6), (2, 0.3, 0.7), (3, 0.4, 0.1), (4, 0.5, 0.2)], "segment_id int, brightness double, ndvi double")
    two = spark.createDataFrame([(1, 0.2, 0.6), (2, 0.3, 0.7), (3, 0.8, 0.5), (4, 0.9, 0.6)], "segment_id int, brightness double, ndvi double")
    assert by_id(change.feature_difference(one, two))[3]["brightness"] == pytest.approx(0.4)
    found = change.detect_changes(one, two, 0.1, normalize=False)
    assert {k for k, r in by_id(found).items() if r["changed"]} == {3, 4}
    s = change.change_summary(found, one, two).first()
    assert (s["total_segments"], s["changed"], s["unchanged"], s["pct_changed"]) == (4, 2, 2, 50.0) and s["mean_diff_changed"]["ndvi"] == pytest.approx(0.4)
    assert {k for k, r in by_id(change.detect_changes(one, two)).items() if r["changed"]} == {3, 4}
    same = change.change_summary(change.detect_changes(one, one), one, one).first()
    assert same["changed"] == 0 and same["mean_diff_changed"] is None
    assert change.change_summary(found.limit(0)).first()["pct_changed"] == 0.0
    pooled = np.concatenate([[0.2, 0.3, 0.4, 0.5], [0.2, 0.3, 0.8, 0.9]]).std(ddof=1), np.concatenate([[0.6, 0.7, 0.1, 0.2], [0.6, 0.7, 0.5, 0.6]]).std(ddof=1)
    assert by_id(change.change_table(one, two))[3]["change_magnitude"] == pytest.approx(math.hypot(0.4 / pooled[0], 0.4 / pooled[1]))


def test_accuracy(spark):
    frame = lambda rows: spark.createDataFrame(rows, "segment_id int, class_label string")
    report = accuracy.assess_accuracy(frame(list(enumerate("abcabc"))), frame(list(enumerate("abcaba"))))
    assert report.overall_accuracy == pytest.approx(5 / 6) and report.kappa == pytest.approx(0.75) and report.matrix == [[2, 0, 0], [0, 2, 0], [1, 0, 1]]
    assert report.per_class["c"] == {"precision": 1.0, "recall": 0.5, "f1": pytest.approx(2 / 3), "support": 2}
    assert "Kappa" in report.summary() and report.to_dict()["class_names"] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        accuracy.assess_accuracy(frame([(1, "a")]), frame([(2, "a")]))


def test_fuzzy(spark):
    table = spark.createDataFrame([(1, 0.7, 0.2), (2, 0.8, 0.15), (3, -0.1, 0.1), (4, 0.0, 0.08), (5, 0.25, 0.35), (6, 0.5, 0.3), (7, float("nan"), 0.1)], "segment_id int, ndvi double, brightness_mean double")
    rules = {"vegetation": [fuzzy.FuzzyRule("ndvi", 0.3, 1, low_edge=0.2)], "water": [fuzzy.FuzzyRule("ndvi", -1, 0.1, high_edge=0.15), fuzzy.FuzzyRule("brightness_mean", 0, 0.12, high_edge=0.15)]}
    classifier = fuzzy.FuzzyClassifier(rules)
    got = {k: r["class_label"] for k, r in by_id(classifier.predict(table)).items()}
    assert got[1] == got[2] == "vegetation" and got[3] == "water" and got[7] == "unclassified"
    assert by_id(classifier.predict_proba(table))[5]["vegetation"] == pytest.approx(0.5)
    assert {r["class_label"] for r in fuzzy.FuzzyClassifier({"x": [fuzzy.FuzzyRule("ndvi", 10, 20)]}).predict(table).collect()} == {"unclassified"}
    with pytest.raises(ValueError):
        fuzzy.FuzzyClassifier().predict(table)
    with pytest.raises(ValueError):
        fuzzy.FuzzyClassifier({"x": [fuzzy.FuzzyRule("no", 0, 1)]}).predict(table)
    assert fuzzy.FuzzyClassifier.from_params(classifier.get_params()).rules == rules
    assert spark.range(1).select(membership(F.lit(0.3), 0.4, 0.8, 0.2)).first()[0] == pytest.approx(0.5)


def clusters(spark, spread=0.3, names=("feat_a", "feat_b")):
    rng = np.random.RandomState(42)
    rows = [(25 * k + i + 1, *(float(v) for v in rng.normal(c, spread))) for k, c in enumerate([(0, 0), (5, 0), (0, 5), (5, 5)]) for i in range(25)]
    table = spark.createDataFrame(rows, "segment_id int, " + ", ".join(f"{n} double" for n in names))
    return table, spark.createDataFrame([(r[0], "abcd"[(r[0] - 1) // 25]) for r in rows], "segment_id int, class_label string")


@pytest.mark.parametrize("method, params", [("kmeans", {"n_clusters": 4, "n_init": 3}), ("gmm", {"n_clusters": 4, "n_init": 6}), ("dbscan", {"eps": 0.5, "min_samples": 4})])
def test_clustering(spark, tmp_path, method, params):
    table, _ = clusters(spark)
    fitted = unsupervised.UnsupervisedClassifier(method, **params).fit(table)
    got = {k: r["cluster"] for k, r in by_id(fitted.predict(table)).items()}
    assert set(got.values()) - {0} == {1, 2, 3, 4}
    if method == "kmeans":
        assert all(len({got[i] for i in range(25 * k + 1, 25 * k + 26)}) == 1 for k in range(4))
    if method != "dbscan":
        fitted.save(str(tmp_path / "m"))
        assert {k: r["cluster"] for k, r in by_id(unsupervised.UnsupervisedClassifier.load(str(tmp_path / "m")).predict(table)).items()} == got
    proba = fitted.predict_proba(table)
    assert (proba is None) == (method != "gmm")
    if proba is not None:
        assert all(abs(sum(v for n, v in r.asDict().items() if n != "segment_id") - 1) < 1e-6 for r in proba.collect())


def test_clustering_errors(spark):
    table, _ = clusters(spark)
    with pytest.raises(ValueError):
        unsupervised.UnsupervisedClassifier("kmeans", n_clusters=200).fit(table)
    with pytest.raises(ValueError):
        unsupervised.UnsupervisedClassifier("other")
    with pytest.raises(RuntimeError):
        unsupervised.UnsupervisedClassifier("kmeans").predict(table)
    far = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(1, 8)], "segment_id int, x double, y double")
    assert {r["cluster"] for r in unsupervised.dbscan(far, 1.0, 3).collect()} == {0}
    fitted = unsupervised.UnsupervisedClassifier("dbscan", min_samples=4).fit(table)
    assert {r["cluster"] for r in fitted.predict(table.withColumn("segment_id", F.col("segment_id") + 1000)).collect()} == {0}


def brute_dbscan(x, eps, least):
    near = [[j for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps * eps] for i in range(len(x))]
    core, label, k = [len(n) >= least for n in near], [0] * len(x), 0
    for i in range(len(x)):
        if core[i] and not label[i]:
            k += 1
            stack = [i]
            while stack:
                j = stack.pop()
                if not label[j]:
                    label[j] = k
                    stack += near[j] if core[j] else []
    return label


def test_dbscan_against_brute_force(spark):
    rng = np.random.RandomState(7)
    x = rng.uniform(0, 10, (120, 3))
    frame = spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(x)], "segment_id int, a double, b double, c double")
    got = {r["segment_id"]: r["cluster"] for r in unsupervised.dbscan(frame, 1.6, 4).collect()}
    assert [got[k + 1] for k in range(len(x))] == brute_dbscan(x, 1.6, 4)


@pytest.mark.parametrize("method, params", [("random_forest", {"n_estimators": 20}), ("svm", {}), ("svm", {"kernel": "linear"}), ("gradient_boosting", {"n_estimators": 5, "max_depth": 3})])
def test_supervised(spark, tmp_path, method, params):
    table, truth = clusters(spark, 0.5)
    fitted = supervised.SupervisedClassifier(method, **params).fit(table, truth)
    found = fitted.predict(table)
    assert accuracy.assess_accuracy(truth, found).overall_accuracy > 0.9
    proba = fitted.predict_proba(table)
    assert proba.columns == ["segment_id", "prob_a", "prob_b", "prob_c", "prob_d"]
    assert all(abs(sum(r[1:]) - 1) < 1e-6 for r in proba.collect())
    if method == "svm":
        with pytest.raises(NotImplementedError):
            fitted.feature_importance()
    else:
        rows = fitted.feature_importance().collect()
        assert rows[0]["importance"] >= rows[1]["importance"] and sum(r["importance"] for r in rows) == pytest.approx(1)
    fitted.save(str(tmp_path / "m"))
    again = supervised.SupervisedClassifier.load(str(tmp_path / "m")).predict(table)
    assert by_id(again) == by_id(found)


def test_supervised_errors_and_folds(spark):
    table, truth = clusters(spark)
    with pytest.raises(ValueError):
        supervised.classify(table, "random_forest")
    with pytest.raises(ValueError):
        supervised.classify(table, "magic")
    with pytest.raises(ValueError, match="No common"):
        supervised.SupervisedClassifier().fit(table, truth.withColumn("segment_id", F.col("segment_id") + 1000))
    with pytest.raises(RuntimeError):
        supervised.SupervisedClassifier().predict(table)
    found = supervised.cross_validate(supervised.SupervisedClassifier("random_forest", n_estimators=5), table, truth, cv=3)
    assert found["mean_accuracy"] > 0.9 and len(found["fold_scores"]) == 3
    sizes = supervised.stratified_folds(truth, 5).groupBy("class_label", "fold").count().collect()
    assert len(sizes) == 20 and {r["count"] for r in sizes} == {5}
    assert {r["weight"] for r in supervised.balanced_weights(truth).collect()} == {1.0}


def two_halves(h=24, w=30):
    image = np.zeros((3, h, w))
    image[:, :, w // 2 :] = 1.0
    return image + RNG.normal(0, 0.01, image.shape)


@pytest.mark.parametrize("method, params", [("slic", {"n_segments": 12}), ("felzenszwalb", {"min_size": 20}), ("shepherd", {"num_clusters": 4, "min_n_pxls": 15}), ("watershed", {"markers": 12, "min_distance": 3})])
def test_segmenters(spark, method, params):
    image = two_halves()
    px = relation(spark, np.zeros(image.shape[1:], int), *image).drop("segment_id")
    rows = segment.segment(px, method, F.col("row") < 2, **params).collect()
    label = np.zeros(image.shape[1:], int)
    for r in rows:
        label[r["row"], r["col"]] = r["segment_id"]
    assert (label[:2] == 0).all() and (label[2:] > 0).all() and len(rows) == label.size
    left, right = set(label[3:, :14].ravel()), set(label[3:, 16:].ravel())
    assert not left & right
    some = segment.segment(px, method, bands=[0], **params)
    assert set(some.columns) >= {"b0", "b1", "b2", "segment_id"} and some.count() == label.size


def test_segmenter_properties():
    from terralith.operators import kernels

    image = RNG.uniform(0, 1, (2, 40, 40))
    smooth = kernels.smoothed(image, 2.0)
    assert kernels.slic(smooth, 64).max() > kernels.slic(smooth, 9).max()
    assert kernels.felzenszwalb(smooth, min_size=5).max() >= kernels.felzenszwalb(smooth, min_size=80).max()
    few = kernels.shepherd(smooth, 8, 40)
    assert np.bincount(few.ravel())[1:].min() >= 40 or few.max() == 1 or kernels.shepherd(smooth, 8, 40, None).max() <= few.max()
    for label in (kernels.slic(smooth, 20), few, kernels.watershed(smooth, 20, 0.0, 3)):
        assert sorted(np.unique(label)) == list(range(1, label.max() + 1))
    assert (kernels.clumps(np.array([[1, 1, 2], [2, 1, 2], [1, 2, 2]])) == np.array([[1, 1, 2], [3, 1, 2], [4, 2, 2]])).all()


def test_pieces_against_a_flood():
    from terralith.operators import kernels

    rng = np.random.default_rng(8)
    for shape, classes in (((1, 1), 1), ((1, 30), 2), ((17, 23), 2), ((20, 20), 3), ((25, 12), 1)):
        kind = rng.integers(0, classes, shape)
        want, n = np.zeros(shape, int), 0
        for start in np.ndindex(shape):
            if want[start]:
                continue
            n, todo = n + 1, [start]
            want[start] = n
            while todo:
                r, c = todo.pop()
                for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= y < shape[0] and 0 <= x < shape[1] and not want[y, x] and kind[y, x] == kind[r, c]:
                        want[y, x] = n
                        todo.append((y, x))
        assert (kernels.clumps(kind) == want).all()
    none = np.zeros(0, int)
    assert (kernels.least_linked(3, none, none) == [0, 1, 2]).all()
    assert (kernels.least_linked(6, np.array([5, 4, 3, 1]), np.array([4, 3, 5, 1])) == [0, 1, 2, 3, 3, 3]).all()


def test_tiles_of_images_of_other_sizes(spark):
    """Each image is stitched to its own ends, and its labels start from 1."""
    from functools import reduce

    sizes = {"wide": (20, 70), "high": (45, 20), "small": (5, 6)}
    parts = [relation(spark, np.zeros(size, int), *two_halves(*size)).drop("segment_id").withColumn("image_id", F.lit(name)) for name, size in sizes.items()]
    got = segment.segment_tiled(reduce(lambda a, b: a.unionByName(b), parts), "slic", tile_size=32, overlap=8, n_segments=9)
    for name, (h, w) in sizes.items():
        own = {(r["row"], r["col"]): r["segment_id"] for r in got.where(F.col("image_id") == name).collect()}
        alone = {(r["row"], r["col"]): r["segment_id"] for r in segment.segment_tiled(parts[list(sizes).index(name)].drop("image_id"), "slic", tile_size=32, overlap=8, n_segments=9).collect()}
        assert len(own) == h * w and min(own.values()) == 1 and own == alone


def test_segmenter_factory():
    assert segment.create("SLIC", n_segments=5).get_params()["n_segments"] == 5 and "sam" in segment.list_methods()
    assert "scale" in segment.create("felzenszwalb").get_param_schema()["properties"]
    with pytest.raises(ValueError):
        segment.create("magic")
    with pytest.raises(ValueError):
        segment.create("slic", scale=3)
    with pytest.raises(ImportError):
        segment.create("sam")


def test_tiles(spark):
    image = two_halves(50, 70)
    px = relation(spark, np.zeros(image.shape[1:], int), *image).drop("segment_id")
    got = segment.segment_tiled(px, "slic", tile_size=32, overlap=8, n_segments=9)
    assert got.count() == 3500 and got.where("segment_id <= 0").count() == 0
    starts = sorted({(r["row_off"], r["col_off"]) for r in segment.tile_windows(px, 32, 8).select("row_off", "col_off").distinct().collect()})
    assert starts == [(r, c) for r in (0, 24, 48) for c in (0, 24, 48)]
    with pytest.raises(ValueError):
        segment.tile_windows(px, 32, 32)


def test_multiscale(spark):
    image = two_halves()
    px = relation(spark, np.zeros(image.shape[1:], int), *image).drop("segment_id")
    levels = segment.segment_multiscale(px, "slic", [6, 24])
    assert levels.n_levels == 2 and levels.finest.n_segments > levels.coarsest.n_segments and levels.finest.scale == 24
    assert levels.parent_map().count() == levels.finest.n_segments
    with pytest.raises(ValueError):
        segment.segment_multiscale(px, "shepherd")


def test_masks(spark):
    rows = [(1, r, c) for r in range(4) for c in range(4)] + [(2, r, c) for r in range(2) for c in range(2)] + [(3, 9, 9)]
    got = {(r["row"], r["col"]): r["segment_id"] for r in segment.overlaid_masks(spark.createDataFrame(rows, "mask_id int, row int, col int"), 2).collect()}
    assert got[0, 0] == 2 and got[3, 3] == 1 and (9, 9) not in got


def test_samples(spark, four):
    _, _, px = four
    at = (1.0, 0.0, 100.0, 0.0, -1.0, 200.0)
    points = spark.createDataFrame([(105.5, 194.5, "a", 0), (115.5, 194.5, "b", 1), (105.2, 195.0, "z", 2), (0.0, 0.0, "out", 3)], "x double, y double, class string, sample_ord int")
    assert {r["segment_id"]: r["class_label"] for r in samples.point_samples(points, px, at).collect()} == {1: "z", 2: "b"}
    boxes = spark.createDataFrame([(100.0, 191.0, 108.0, 200.0, "veg", 0), (108.0, 188.0, 112.0, 192.0, "all", 1), (-50.0, 300.0, -10.0, 400.0, "out", 2)], "min_x double, min_y double, max_x double, max_y double, class string, sample_ord int")
    assert {r["segment_id"]: r["class_label"] for r in samples.box_samples(boxes, px, at, cells=4).collect()} == {1: "all", 2: "all", 3: "all", 4: "all"}
    ring = [(100.0, 200.0), (109.0, 200.0), (100.0, 191.0)]
    polygons = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], "tri", 0)], "ring array<struct<x:double,y:double>>, class string, sample_ord int")
    assert {r["segment_id"]: r["class_label"] for r in samples.polygon_samples(polygons, px, at).collect()} == {1: "tri"}
    assert samples.segment_at(px, 115.0, 181.0, at).first()["segment_id"] == 4 and samples.segment_at(px, 0.0, 0.0, at).count() == 0
    own = spark.createDataFrame([(1, "a"), (2, "b")], "segment_id int, class_label string")
    new = spark.createDataFrame([(2, "c"), (3, "c")], "segment_id int, class_label string")
    assert {(r[0], r[1]) for r in samples.upserted(own, new).collect()} == {(1, "a"), (2, "c"), (3, "c")}
    assert {r[0] for r in samples.removed(own, new).collect()} == {1} and samples.without_class(own, "a").count() == 1
    assert {r["class_label"] for r in samples.renamed_class(own, "a", "x").collect()} == {"x", "b"}


def test_vectorize(spark):
    label = np.zeros((10, 10), int)
    label[2:8, 2:8] = 1
    label[4:6, 4:6] = 2
    label[0, 0] = label[1, 1] = 3
    edges = defaultdict(list)
    for r in vectorize.outline(relation(spark, label)).collect():
        edges[r["segment_id"]].append((r["r0"], r["c0"], r["r1"], r["c1"]))
    one = vectorize.polygons(edges[1])
    assert len(one) == 1 and len(one[0]) == 2 and vectorize.area(one[0][0]) == 36 and vectorize.area(one[0][1]) == -4
    assert len(vectorize.polygons(edges[3])) == 2 and all(vectorize.area(p[0]) == 1 for p in vectorize.polygons(edges[3]))
    rng = np.random.RandomState(0)
    for _ in range(20):
        random = rng.randint(0, 2, (7, 8))
        cells = {(r, c) for r, c in zip(*np.nonzero(random), strict=True)}
        own = [(r + a, c + b, r + y, c + x) for r, c in cells for dr, dc, a, b, y, x in vectorize.EDGES if (r + dr, c + dc) not in cells]
        parts = vectorize.polygons(own)
        assert sum(vectorize.area(ring) for rings in parts for ring in rings) == len(cells)
        from terralith.operators.kernels import clumps

        pieces = np.unique(clumps(random)[random == 1])
        assert len(parts) == len(pieces)
    layer = vectorize.vectorize(relation(spark, label), (10.0, 0, 500.0, 0, -10.0, 1000.0), 32633)
    assert layer.count() == 3 and layer.first()["srid"] == 32633


def test_explore(spark):
    table = spark.createDataFrame([(k, float(k), float("nan") if k == 3 else 1.0) for k in range(1, 41)], "segment_id int, a double, b double")
    rows = {r["feature"]: r for r in explore.feature_summary(table).collect()}
    assert rows["a"]["median"] == 20.5 and rows["b"]["count"] == 39 and rows["a"]["std"] == pytest.approx(np.arange(1, 41).std(ddof=1))
    bars = explore.histogram(table, "a").orderBy("bin").collect()
    assert len(bars) == 10 and sum(r["n"] for r in bars) == 40 and bars[-1]["high"] == 40
    assert explore.histogram(table, "b", 4).orderBy("bin").first()["n"] == 39
    assert {r["interval"] for r in explore.equal_intervals(table, "a").collect()} == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        explore.equal_intervals(table, "a", 2)
    assert explore.bins_for(10) == 10 and explore.bins_for(100_000) == 50
    classes = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "segment_id int, class_label string")
    assert [(r[0], r[1], r[2]) for r in explore.class_frequency(classes).collect()] == [("b", 2, 66.7), ("a", 1, 33.3)]
    px = relation(spark, np.array([[0, 1], [2, 4]]))
    assert {(r["row"], r["col"]): r["code"] for r in explore.classified_raster(px, classes).collect()} == {(0, 0): 0, (0, 1): 2, (1, 0): 1, (1, 1): 0}
    boxes = spark.createDataFrame([(3, 0.0, 0.0, 5.0, 5.0)], "segment_id int, min_x double, min_y double, max_x double, max_y double")
    assert explore.inspect(table, boxes, 1, 1, "b").first()["shown"] == "N/A" and explore.inspect(table, boxes, 1, 1, "a").first()["shown"].startswith("3")


def test_scaling(spark):
    row = spark.range(1).select(scaled_10000(F.lit(0.5), F.lit(0.0), F.lit(1.0)).alias("a"), as_uint8(F.lit(0.5), F.lit(1.0)).alias("b"), as_uint8(F.lit(300.0), F.lit(900.0)).alias("c"), *(x.alias(n) for n, x in zip("rk", grid_row_col(F.lit(105.5), F.lit(194.5), (1, 0, 100, 0, -1, 200)), strict=True))).first()
    assert tuple(row) == (5000, 127, 255, 5, 5)


def test_last_sample_counts_whatever_its_kind(spark, four):
    _, _, px = four
    at = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    points = spark.createDataFrame([(2.5, -2.5, "point", 0), (12.5, -2.5, "point", 3)], "x double, y double, class string, sample_ord int")
    boxes = spark.createDataFrame([(1.0, -4.0, 4.0, -1.0, "box", 1), (11.0, -4.0, 14.0, -1.0, "box", 2)], "min_x double, min_y double, max_x double, max_y double, class string, sample_ord int")
    got = {r["segment_id"]: r["class_label"] for r in samples.all_samples(points, boxes, px, at).collect()}
    assert got == {1: "box", 2: "point"}
    assert samples.all_samples(points, boxes, px, at).columns == ["segment_id", "class_label"]


def test_shepherd_leaves_nodata_out(spark):
    img = np.zeros((1, 12, 12))
    img[0, :, :6], img[0, :, 6:] = 10, 90
    img[0, 5:7] = -50
    valid = np.ones((12, 12), bool)
    valid[5:7] = False
    got = kernels.shepherd(img, 2, 4, None, valid=valid)
    assert (got[5:7] == 0).all() and len(np.unique(got[valid])) == 4 and got.max() == 4
    assert (kernels.shepherd(img, 2, 4, None, valid=valid & False) == 0).all()
    px = relation(spark, np.ones((12, 12), int), img[0]).drop("segment_id")
    for found in (segment.segment(px, "shepherd", F.col("b0") == -50, num_clusters=2, min_n_pxls=4, dist_thres=None), segment.segment_tiled(px, "shepherd", 64, 8, F.col("b0") == -50, num_clusters=2, min_n_pxls=4, dist_thres=None)):
        assert {(r["row"], r["col"]): r["segment_id"] for r in found.collect()} == {(r, c): int(got[r, c]) for r in range(12) for c in range(12)}


def test_polygons_are_as_large_as_their_pixels(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 4, (9, 9))
    got = by_id(vectorize.measured(vectorize.vectorize(relation(spark, label), (2.0, 0.0, 0.0, 0.0, -2.0, 0.0))))
    for k in (1, 2, 3):
        r, c = np.nonzero(label == k)
        assert got[k]["area"] == 4 * len(r) and (got[k]["min_x"], got[k]["max_x"], got[k]["min_y"], got[k]["max_y"]) == (2 * c.min(), 2 * c.max() + 2, -2 * r.max() - 2, -2 * r.min())
    ring = np.ones((3, 3), int)
    ring[1, 1] = 0
    assert by_id(vectorize.measured(vectorize.vectorize(relation(spark, ring))))[1]["n_rings"] == 2


def test_labels_and_predictions_without_a_partner(spark):
    true = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (9, "b")], "segment_id int, class_label string")
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (7, "a")], "segment_id int, class_label string")
    got = accuracy.overall(true, found).first()
    assert got["n"] == 3 and got["overall_accuracy"] == pytest.approx(2 / 3)
    merged = {r["segment_id"]: (r["x"], r["y"]) for r in features.merged([true.selectExpr("segment_id", "1 AS x"), found.selectExpr("segment_id", "2 AS y")]).collect()}
    assert merged == {1: (1, 2), 2: (1, 2), 3: (1, 2), 9: (1, None), 7: (None, 2)}


def copies(spark, n, copied, seed=3):
    """Points with whole features, each of them copied times, and some of their own."""
    rng = np.random.RandomState(seed)
    x = np.concatenate([np.repeat(rng.randint(0, 40, (n, 2)), copied, axis=0), rng.randint(-30, 80, (n, 2))]).astype(float)
    return x, spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(x)], "segment_id int, x double, y double")


def test_dbscan_of_copies(spark):
    x, frame = copies(spark, 40, 5)
    for eps, least in ((2.5, 4), (6.0, 12), (0.0, 3)):
        got = {r["segment_id"]: r["cluster"] for r in unsupervised.dbscan(frame, eps, least).collect()}
        assert [got[k + 1] for k in range(len(x))] == brute_dbscan(x, eps, least)


def test_dbscan_links_cells_of_copies_once(spark, monkeypatch):
    x, frame = copies(spark, 40, 20)
    seen, connected = [], unsupervised.connected
    monkeypatch.setattr(unsupervised, "connected", lambda edges, vertices: seen.append((edges.count(), vertices.count())) or connected(edges, vertices))
    got = {r["segment_id"]: r["cluster"] for r in unsupervised.dbscan(frame, 6.0, 12).collect()}
    assert [got[k + 1] for k in range(len(x))] == brute_dbscan(x, 6.0, 12)
    assert seen[0][0] <= 24 * seen[0][1] and seen[0][1] <= 40  # not rows: 800 of them are copies


def test_core_points_of_copies(spark):
    x, frame = copies(spark, 40, 5)
    want = (((x[:, None] - x[None]) ** 2).sum(2) <= 36).sum(1)
    found = unsupervised.core_points(frame, 6.0, 12)
    assert {r["segment_id"]: r["n_neighbors"] for r in found.collect()} == {k + 1: n for k, n in enumerate(want) if n >= 12}


@pytest.mark.parametrize("size, eps", [(1, 0.5), (2, 12.0), (4, 30.0)])
def test_core_points_count_dense_places_without_pairs(spark, monkeypatch, size, eps):
    monkeypatch.setattr(unsupervised, "BLOCK", 100)
    monkeypatch.setattr(unsupervised, "LEAF", 8)
    x = np.random.RandomState(5).normal(0, 20, (1500, size))
    x[1000:1100], x[1200:1300] = x[:100], np.round(x[1200:1300])  # copies, and places on a lattice, some just eps apart
    want = np.concatenate([(((x[k : k + 500, None] - x[None]) ** 2).sum(2) <= eps * eps).sum(1) for k in range(0, len(x), 500)])
    names = [f"f{i}" for i in range(size)]
    frame = spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(x)], "segment_id int, " + ", ".join(f"{n} double" for n in names))
    compared, between = spark.sparkContext.accumulator(0), unsupervised._between

    def counted(a, b):
        compared.add(len(a) * len(b))
        return between(a, b)

    monkeypatch.setattr(unsupervised, "_between", counted)
    assert {r["segment_id"]: r["n_neighbors"] for r in unsupervised.core_points(frame, eps, 5).collect()} == {k + 1: n for k, n in enumerate(want) if n >= 5}
    assert size > 2 or compared.value < want.sum() / 2  # a pair of places within eps each, or more, by joins


def test_core_points_of_places_far_out_or_without_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1e30, 0.0)] * 3 + [(1.0, 1.0), (1.0, 1.5), (1.5, 1.0)] + [(-1e30, 2.0), (nan, 1.0), (nan, 1.0), (inf, 1.0), (inf, 1.0), (None, 1.0), (None, 1.0)]
    frame = spark.createDataFrame([(k + 1, *p) for k, p in enumerate(rows)], "segment_id int, x double, y double")
    for eps, want in ((1.0, {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3}), (0.0, {1: 3, 2: 3, 3: 3})):
        assert {r["segment_id"]: r["n_neighbors"] for r in unsupervised.core_points(frame, eps, 2).collect()} == want
    assert not unsupervised.core_points(frame.limit(0), 1.0, 1).count()


def test_kth_distances_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(unsupervised, "BLOCK", 16)
    x, frame = copies(spark, 40, 5)
    want = np.sqrt(np.sort(((x[:, None] - x[None]) ** 2).sum(2), axis=1))
    asked, least = spark.sparkContext.accumulator(0), unsupervised._least

    def counted(mine, theirs, k):
        asked.add(len(mine) * len(theirs))
        return least(mine, theirs, k)

    monkeypatch.setattr(unsupervised, "_least", counted)
    for k in (1, 5, 9, len(x)):
        got = {r["segment_id"]: r["distance"] for r in unsupervised.kth_distances(frame, k).collect()}
        assert [got[i + 1] for i in range(len(x))] == pytest.approx(list(want[:, k - 1]))
        assert k > 9 or asked.value < len(x) ** 2 / 4  # all rows against all would be its square
        asked.value = 0
    assert unsupervised.auto_eps(frame, 5).first()["eps"] == pytest.approx(np.median(want[:, 4]))


def test_forest_splits_at_any_value_and_depth(spark, monkeypatch):
    rows = [(k, float(k), "ab"[k % 2]) for k in range(1, 151)]
    table = spark.createDataFrame([r[:2] for r in rows], "segment_id int, x double")
    truth = spark.createDataFrame([(k, c) for k, _, c in rows], "segment_id int, class_label string")

    def right(**params):
        fitted = supervised.SupervisedClassifier("random_forest", n_estimators=30, min_samples_split=2, **params).fit(table, truth)
        assert [tuple(r) for r in fitted.feature_importance().collect()] == [("x", pytest.approx(1))]
        return sum(r["class_label"] == "ab"[k % 2] for k, r in by_id(fitted.predict(table)).items()), by_id(fitted.predict_proba(table))

    # 32 bins and 30 levels, as in MLlib, can't tell 150 values apart
    whole, chances = right()
    assert whole > 140
    assert right()[1] == chances and right(random_state=1)[1] != chances
    monkeypatch.setattr(supervised.forest, "BLOCK", 20)
    monkeypatch.setattr(supervised.forest, "_groups", lambda df, trees: 3)
    assert {k: tuple(r) for k, r in right()[1].items()} == {k: pytest.approx(tuple(r)) for k, r in chances.items()}
    monkeypatch.setattr(supervised.forest, "CELLS", 149)
    assert right()[0] < whole  # by MLlib


def test_texture_counts_each_pair_once(spark):
    px = spark.createDataFrame([(0, c, float(v), 1) for c, v in enumerate((0, 7, 0, 7, 7, 0))], "row int, col int, b0 double, segment_id int")
    found = texture.cooccurrence(px, levels=8)
    # 0-7 and 7-0 are one pair of levels: two rows before
    assert sorted((r["pair"], r["i"], r["j"], r["n"]) for r in found.collect()) == [(0, 0, 7, 4), (0, 7, 7, 1)]
    got = texture.texture(px, levels=8, angles=(0.0,)).first()
    assert got["glcm_contrast_b0"] == pytest.approx(49 * 8 / 10) and got["glcm_energy_b0"] == pytest.approx(math.sqrt(0.4**2 * 2 + 0.2**2))


def test_slic_takes_little_memory_for_noise(spark):
    import tracemalloc

    image = np.random.RandomState(5).randint(0, 500, (3, 300, 100)).astype(float)
    tracemalloc.start()
    got = kernels.slic(image, n_segments=20)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.min() == 1 and len(np.unique(got)) == got.max()
    assert most < 300 * got.size  # 3 bands are 24 bytes; sets of neighbours took some 800


def test_absorbed_goes_by_size_and_keeps_nodata():
    labels = np.array([[1, 1, 1, 2, 3], [0, 4, 5, 5, 5]], np.int32)
    image = np.array([[[0, 0, 0, 6, 7], [0, 9, 8, 8, 8]]], float)
    # 2 goes to 3 (nearest), then 4 to 5, then 2 and 3 together to 5
    assert kernels.absorbed(image, labels, 3).tolist() == [[1, 1, 1, 2, 2], [0, 2, 2, 2, 2]]
    assert kernels.absorbed(image, labels, 3, 0.5).tolist() == labels.tolist()

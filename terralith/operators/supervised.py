"""Supervised classification: forests by trees grown in tasks, or by MLlib where a task can't hold the table, boosted trees by MLlib, support vectors by a bounded fit and a column rule."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import forest
from .labels import keys
from .unsupervised import FITS_AT_ONCE, assembled, feature_columns

ALGORITHMS = ("random_forest", "svm", "gradient_boosting")
#: name: (default, type, meaning) of each algorithm's parameters.
SCHEMA = {
    "random_forest": {"n_estimators": (100, "integer", "Trees"), "max_depth": (None, "integer", "Depth; none has no end, or 30 by MLlib"), "min_samples_split": (5, "integer", "Least rows that are split"), "max_features": ("sqrt", "string", "Features tried at a split"), "class_weight": ("balanced", "string", "Weights"), "random_state": (42, "integer", "Seed")},
    "svm": {"kernel": ("rbf", "string", "rbf or linear"), "C": (1.0, "number", "Cost of errors"), "gamma": ("scale", "mixed", "Width of the kernel"), "class_weight": ("balanced", "string", "Weights"), "max_rows": (4000, "integer", "Training rows at most: a bounded sample of the labelled ones")},
    "gradient_boosting": {"n_estimators": (100, "integer", "Rounds"), "max_depth": (5, "integer", "Depth"), "learning_rate": (0.1, "number", "Step"), "random_state": (42, "integer", "Seed")},
}
#: The deepest tree that MLlib grows.
DEEPEST = 30


def balanced_weights(labels: DataFrame, column: str = "class_label") -> DataFrame:
    """class_label, weight: rows / (classes * rows of the class)."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return counts.join(F.broadcast(whole)).select(column, (F.col("_rows") / (F.col("_classes") * F.col("n"))).alias("weight"))


class SupportVectors:
    """One against one, each pair by coordinate ascent on the dual; the votes decide, ties go to the first class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kernel: str, cost: float, gamma: float | str, balanced: bool) -> None:
        self.kernel, self.classes = kernel, int(y.max()) + 1
        spread = x.var()
        self.gamma = 1 / (x.shape[1] * spread) if gamma == "scale" and spread > 0 else 1 / x.shape[1] if isinstance(gamma, str) else float(gamma)
        weights = len(y) / (self.classes * np.maximum(np.bincount(y, minlength=self.classes), 1)) if balanced else np.ones(self.classes)
        self.pairs = []
        for a in range(self.classes):
            for b in range(a + 1, self.classes):
                some = np.flatnonzero((y == a) | (y == b))
                sign = np.where(y[some] == a, 1.0, -1.0)
                self.pairs.append((a, b, *self._fit(x[some], sign, cost * weights[y[some]])))

    def _gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return a @ b.T
        return np.exp(-self.gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))

    def _fit(self, x: np.ndarray, sign: np.ndarray, most: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
        # the bias is a constant feature of the kernel, so that each multiplier can be moved by itself
        gram = self._gram(x, x) + 1.0
        alpha, out = np.zeros(len(x)), np.zeros(len(x))
        order = np.random.default_rng(0)
        for _ in range(rounds):
            moved = 0.0
            for i in order.permutation(len(x)).tolist():
                step = (1 - sign[i] * out[i]) / gram[i, i]
                new = min(most[i], max(0.0, alpha[i] + step))
                if new != alpha[i]:
                    out += (new - alpha[i]) * sign[i] * gram[i]
                    moved = max(moved, abs(new - alpha[i]))
                    alpha[i] = new
            if moved < 1e-4:
                break
        support = alpha > 1e-9
        return x[support], (alpha * sign)[support], float((alpha * sign).sum())

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._gram(x, s) @ c + bias for _, _, s, c, bias in self.pairs], 1) if self.pairs else np.zeros((len(x), 0))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Each pair's margin as a chance, summed over the pairs of a class."""
        out = np.zeros((len(x), self.classes))
        for (a, b, *_), m in zip(self.pairs, self.margins(x).T, strict=True):
            p = 1 / (1 + np.exp(-2 * m))
            out[:, a] += p
            out[:, b] += 1 - p
        return out / out.sum(1, keepdims=True) if self.pairs else np.ones((len(x), 1))

    def state(self) -> dict:
        return {"kernel": self.kernel, "gamma": self.gamma, "classes": self.classes, "pairs": [[a, b, s.tolist(), c.tolist(), bias] for a, b, s, c, bias in self.pairs]}

    @classmethod
    def of_state(cls, state: dict) -> SupportVectors:
        out = cls.__new__(cls)
        out.kernel, out.gamma, out.classes = state["kernel"], state["gamma"], state["classes"]
        out.pairs = [(a, b, np.asarray(s, float), np.asarray(c, float), bias) for a, b, s, c, bias in state["pairs"]]
        return out


class SupervisedClassifier:
    """random_forest, svm or gradient_boosting on the features of labelled segments."""

    def __init__(self, algorithm: str = "random_forest", **params) -> None:
        if algorithm not in ALGORITHMS:
            raise ValueError(f"Unknown algorithm: {algorithm!r}. Available: {ALGORITHMS}")
        if unknown := sorted(set(params) - set(SCHEMA[algorithm])):
            raise ValueError(f"Unknown parameter of {algorithm}: {unknown[0]!r}")
        self.algorithm, self.params = algorithm, {k: v[0] for k, v in SCHEMA[algorithm].items()} | params
        self.feature_names: list[str] | None = None
        self.classes: list[str] = []
        self.model = None
        self.scale: list[tuple[float, float]] = []

    def get_params(self) -> dict:
        return {"algorithm": self.algorithm, **self.params}

    @staticmethod
    def get_param_schema(algorithm: str) -> dict:
        return {"type": "object", "properties": {k: {"type": t, "default": d, "description": s} for k, (d, t, s) in SCHEMA[algorithm].items()}}

    def fit(self, features: DataFrame, labels: DataFrame | None = None) -> SupervisedClassifier:
        if labels is None:
            raise ValueError("Supervised classification requires training labels")
        self.feature_names = feature_columns(features)
        both = features.join(labels.select("segment_id", F.col("class_label").cast("string").alias("class_label")), "segment_id").where("class_label is not null")
        self.classes = sorted(r[0] for r in both.select("class_label").distinct().collect())
        if not self.classes:
            self.feature_names = None
            raise ValueError("No common segment IDs between features and training labels")
        code = F.array_position(F.array(*map(F.lit, self.classes)), F.col("class_label")) - 1
        names = self.feature_names
        rows = assembled(both, names).join(both.select(*keys(both), code.cast("double").alias("_y"), "class_label"), keys(both))
        p = self.params
        if self.algorithm == "svm":
            stats = both.agg(*(f(F.col(c).cast("double")) for c in names for f in (F.avg, F.stddev_pop))).first()
            self.scale = [(stats[2 * i], stats[2 * i + 1] or 1.0) for i in range(len(names))]
            sample = both.select(*(F.col(c).cast("double").alias(c) for c in names), code.cast("int").alias("_y"), "segment_id").orderBy(F.xxhash64("segment_id")).limit(p["max_rows"]).toPandas()
            self.model = SupportVectors(self._standard(sample[names].to_numpy(float)), sample["_y"].to_numpy(int), p["kernel"], float(p["C"]), p["gamma"], p["class_weight"] == "balanced")
            return self
        if self.algorithm == "random_forest":
            if both.count() * max(len(names), len(self.classes)) <= forest.CELLS:
                weight = {r["class_label"]: r["weight"] for r in balanced_weights(both).collect()} if p["class_weight"] == "balanced" else {}  # a row for each class
                ordered = assembled(both, names).join(both.select(*keys(both), code.cast("int").alias("_y")), keys(both)).select("_x", "_y", F.xxhash64(*keys(both)).alias("_o"))
                self.model = forest.Forest.fit(ordered, [weight.get(c, 1.0) for c in self.classes], p["n_estimators"], p["max_features"], p["min_samples_split"], p["max_depth"] or None, p["random_state"])
                return self
            rows = rows.join(F.broadcast(balanced_weights(both)), "class_label") if p["class_weight"] == "balanced" else rows.withColumn("weight", F.lit(1.0))
            # the least rows of a split are at least twice those of a leaf
            learner = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", predictionCol="_p", numTrees=p["n_estimators"], maxDepth=min(DEEPEST, p["max_depth"] or DEEPEST), minInstancesPerNode=max(1, p["min_samples_split"] // 2), featureSubsetStrategy=str(p["max_features"] or "all"), seed=p["random_state"])
        else:
            boosted = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"], seed=p["random_state"])
            learner = boosted if len(self.classes) <= 2 else OneVsRest(classifier=boosted, featuresCol="_x", labelCol="_y", predictionCol="_p")
        self.model = learner.fit(rows)
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return (x - [m for m, _ in self.scale]) / [s for _, s in self.scale]

    def _chances(self, features: DataFrame) -> DataFrame:
        """keys and _q, an array with the chance of each class."""
        if self.feature_names is None:
            raise RuntimeError("Classifier has not been fitted")
        names, by = self.feature_names, keys(features)
        if self.algorithm == "svm":
            model, standard = self.model, self._standard
            shown = features.select(*by, F.array(*[F.col(c).cast("double") for c in names]).alias("_a"))
            types = {f.name: f.dataType.simpleString() for f in shown.schema}

            def scored(batches):
                for pdf in batches:
                    out = pdf[by].copy()
                    out["_q"] = list(model.probabilities(standard(np.stack(pdf["_a"].to_list())))) if len(pdf) else []
                    yield out

            return shown.mapInPandas(scored, ", ".join(f"{c} {types[c]}" for c in by) + ", _q array<double>")
        if isinstance(self.model, forest.Forest):
            return self.model.chances(assembled(features, names), by)
        out = self.model.transform(assembled(features, names))
        if self.algorithm == "random_forest" or len(self.classes) <= 2:
            return out.select(*by, vector_to_array("probability").alias("_q"))
        # raw scores of one model against the rest each, made to add up to 1
        chance = F.transform(vector_to_array("rawPrediction"), lambda r: 1 / (1 + F.exp(-2 * r)))
        total = F.aggregate("_c", F.lit(0.0), lambda a, v: a + v)
        return out.select(*by, chance.alias("_c")).select(*by, F.transform("_c", lambda v: v / total).alias("_q"))

    def predict(self, features: DataFrame) -> DataFrame:
        best = F.array_position("_q", F.array_max("_q")).cast("int")
        name: Column = F.element_at(F.array(*map(F.lit, self.classes)), best) if self.classes else F.lit(None)
        return self._chances(features).select(*keys(features), name.alias("class_label"))

    def predict_proba(self, features: DataFrame) -> DataFrame:
        return self._chances(features).select(*keys(features), *(F.col("_q")[i].alias(f"prob_{c}") for i, c in enumerate(self.classes)))

    def feature_importance(self) -> DataFrame:
        """feature, importance: largest first. Support vectors have none."""
        if self.feature_names is None:
            raise RuntimeError("Classifier has not been fitted")
        if self.algorithm == "svm":
            raise NotImplementedError("Support vectors have no feature importance")
        models = self.model.models if hasattr(self.model, "models") else [self.model]
        mean = self.model.importances if isinstance(self.model, forest.Forest) else np.mean([m.featureImportances.toArray() for m in models], axis=0)
        rows = [(n, float(v)) for n, v in zip(self.feature_names, mean, strict=True)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        from ..sources.tables import write_text

        spark = SparkSession.getActiveSession()
        state = {"kind": "supervised", "algorithm": self.algorithm, "params": self.params, "features": self.feature_names, "classes": self.classes, "scale": self.scale}
        if self.algorithm == "svm" and self.model is not None:
            state["svm"] = self.model.state()
        elif isinstance(self.model, forest.Forest):
            state["forest"] = True
            self.model.trees.write.mode("overwrite").parquet(f"{path}/model")
        elif self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        write_text(spark, f"{path}/state.json", json.dumps(state))

    @classmethod
    def load(cls, path: str) -> SupervisedClassifier:
        from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel

        from ..sources.tables import read_text

        spark = SparkSession.getActiveSession()
        state = json.loads(read_text(spark, f"{path}/state.json"))
        if not isinstance(state, dict) or state.get("kind") != "supervised":
            raise TypeError("Not a saved classifier")
        out = cls(state["algorithm"], **state["params"])
        out.feature_names, out.classes, out.scale = state["features"], state["classes"], [tuple(x) for x in state["scale"]]
        if out.algorithm == "svm":
            out.model = SupportVectors.of_state(state["svm"])
        elif state.get("forest"):
            out.model = forest.Forest.of(spark.read.parquet(f"{path}/model"), len(out.classes))
        else:
            kind = RandomForestClassificationModel if out.algorithm == "random_forest" else GBTClassificationModel if len(out.classes) <= 2 else OneVsRestModel
            out.model = kind.load(f"{path}/model")
        return out


def stratified_folds(labels: DataFrame, cv: int = 5) -> DataFrame:
    """segment_id, class_label, fold (0 to cv - 1): each class is dealt out in the order of its ids, in equal parts."""
    of_class = Window.partitionBy("class_label")
    rank = F.row_number().over(of_class.orderBy("segment_id")) - 1
    return labels.select("segment_id", "class_label", F.floor(rank * cv / F.count(F.lit(1)).over(of_class)).cast("int").alias("fold"))


def cross_validate(classifier: SupervisedClassifier, features: DataFrame, labels: DataFrame, cv: int = 5) -> dict:
    """mean_accuracy, std_accuracy (of the population) and fold_scores; support vectors are scaled within each fold."""
    folds = stratified_folds(labels.join(features.select("segment_id"), "segment_id"), cv).persist()

    def score(k: int) -> float:
        fitted = SupervisedClassifier(classifier.algorithm, **classifier.params).fit(features, folds.where(F.col("fold") != k))
        held = folds.where(F.col("fold") == k).select("segment_id", F.col("class_label").cast("string").alias("true"))
        found = fitted.predict(features.join(held.select("segment_id"), "segment_id")).join(held, "segment_id")
        return found.agg(F.avg((F.col("class_label") == F.col("true")).cast("double"))).first()[0] or 0.0

    try:
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            scores = list(pool.map(score, range(cv)))
    finally:
        folds.unpersist()
    mean = sum(scores) / len(scores)
    return {"mean_accuracy": mean, "std_accuracy": math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), "fold_scores": scores}


def classify(features: DataFrame, method: str = "random_forest", training_labels: DataFrame | None = None, progress=None, **params) -> DataFrame:
    """segment_id and class_label, or cluster for kmeans, gmm and dbscan, by the method's name."""
    from .fuzzy import FuzzyClassifier
    from .unsupervised import ALGORITHMS as CLUSTERINGS
    from .unsupervised import UnsupervisedClassifier

    told = progress or (lambda percent: None)
    told(0.0)
    if method in ALGORITHMS:
        if training_labels is None:
            raise ValueError(f"{method} requires training_labels")
        fitted = SupervisedClassifier(method, **params).fit(features, training_labels)
    elif method in CLUSTERINGS:
        fitted = UnsupervisedClassifier(method, **params).fit(features)
    elif method == "fuzzy":
        fitted = FuzzyClassifier.from_params(params)
    else:
        raise ValueError(f"Unknown classification method: {method!r}. Available: {', '.join((*ALGORITHMS, *CLUSTERINGS, 'fuzzy'))}")
    told(50.0)
    out = fitted.predict(features)
    told(100.0)
    return out

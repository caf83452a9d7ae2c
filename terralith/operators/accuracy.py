"""Accuracy of a classification against true labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded


def _joined(true: DataFrame, predicted: DataFrame) -> DataFrame:
    a = true.select("segment_id", F.col("class_label").cast("string").alias("true"))
    return a.join(predicted.select("segment_id", F.col("class_label").cast("string").alias("predicted")), "segment_id")


def confusion(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """true, predicted, n over the common segments."""
    return _joined(true, predicted).groupBy("true", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row for each pair of true classes, pairs that don't occur included; classes only predicted are left out."""
    counts = confusion(true, predicted)
    classes = counts.select("true").distinct()
    # as many rows as classes
    pairs = classes.join(F.broadcast(classes.select(F.col("true").alias("predicted"))))
    return pairs.join(counts, ["true", "predicted"], "left").select("true", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def overall(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: n, overall_accuracy and kappa, over the classes of both sides."""
    counts = confusion(true, predicted)
    n = F.col("n")
    label = F.explode(F.array(F.struct(F.col("true").alias("label"), n.alias("rows"), F.lit(0).cast("bigint").alias("cols")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("rows"), n.alias("cols"))))
    margins = counts.select(label.alias("m")).groupBy("m.label").agg(F.sum("m.rows").alias("r"), F.sum("m.cols").alias("c"))
    chance = margins.agg(F.sum(F.col("r") * F.col("c")).alias("chance"))
    total = counts.agg(F.sum(n).alias("n"), F.sum(F.when(F.col("true") == F.col("predicted"), n).otherwise(0)).alias("hits"))
    both = total.join(F.broadcast(chance))
    square = n * n
    # (hits/n - chance/n^2) / (1 - chance/n^2), over whole numbers
    kappa = F.when(square == F.col("chance"), F.lit(float("nan"))).otherwise(F.try_divide((F.col("hits") * n - F.col("chance")).cast("double"), (square - F.col("chance")).cast("double")))
    return both.select("n", guarded(F.col("hits"), n).alias("overall_accuracy"), kappa.alias("kappa"))


def per_class(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """class_label, precision, recall, f1, support of each true class; what would divide by 0 is 0."""
    counts = confusion(true, predicted)
    hit = F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = counts.groupBy(F.col("true").alias("class_label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    cols = counts.groupBy(F.col("predicted").alias("class_label")).agg(F.sum("n").alias("given"))
    both = rows.join(cols, "class_label", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    return both.select(
        "class_label", guarded(F.col("hits"), F.col("given")).alias("precision"), guarded(F.col("hits"), F.col("support")).alias("recall"),
        guarded(2 * F.col("hits"), F.col("given") + F.col("support")).alias("f1"), "support",
    )


@dataclass
class AccuracyReport:
    overall_accuracy: float
    kappa: float
    classes: list[str]
    matrix: list[list[int]]
    per_class: dict[str, dict[str, float]]

    def to_dict(self) -> dict:
        return {"overall_accuracy": self.overall_accuracy, "kappa": self.kappa, "class_names": self.classes, "confusion_matrix": self.matrix, "per_class": self.per_class}

    def summary(self) -> str:
        lines = [f"Overall accuracy: {self.overall_accuracy:.4f}", f"Kappa: {self.kappa:.4f}", "", f"{'class':<20}{'precision':>10}{'recall':>10}{'f1':>10}{'support':>10}"]
        return "\n".join(lines + [f"{c:<20}{m['precision']:>10.4f}{m['recall']:>10.4f}{m['f1']:>10.4f}{m['support']:>10d}" for c, m in self.per_class.items()])


def assess_accuracy(true: DataFrame, predicted: DataFrame) -> AccuracyReport:
    """The report over the common segments; ValueError if there are none. Its size is that of the classes."""
    total = overall(true, predicted).first()
    if not total["n"]:
        raise ValueError("No common segment IDs between true and predicted labels")
    rows = {(r["true"], r["predicted"]): r["n"] for r in confusion_matrix(true, predicted).collect()}
    classes = sorted({a for a, _ in rows})
    each = {r["class_label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in per_class(true, predicted).collect()}
    return AccuracyReport(total["overall_accuracy"], total["kappa"], classes, [[rows[a, b] for b in classes] for a in classes], {c: each[c] for c in classes})

"""Change between two tables of features of the same segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import guarded
from .labels import keys

#: Bins of the histogram that Otsu's threshold is found in.
BINS = 256


def common_features(t1: DataFrame, t2: DataFrame) -> list[str]:
    """Numeric columns of t1 that t2 has too."""
    return [f.name for f in t1.schema if f.name in t2.columns and f.name not in ("image_id", "segment_id") and isinstance(f.dataType, T.NumericType)]


def _aligned(t1: DataFrame, t2: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    by, names = keys(t1), common_features(t1, t2)
    a = t1.select(*by, *(F.col(c).cast("double").alias(f"_a_{c}") for c in names))
    b = t2.select(*by, *(F.col(c).cast("double").alias(f"_b_{c}") for c in names))
    return a.join(b, by), by, names


def feature_difference(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """t2 - t1 of the common features of the common segments."""
    both, by, names = _aligned(t1, t2)
    return both.select(*by, *((F.col(f"_b_{c}") - F.col(f"_a_{c}")).alias(c) for c in names))


def change_magnitude(t1: DataFrame, t2: DataFrame, normalize: bool = True) -> DataFrame:
    """change_magnitude of each common segment: the length of its difference.

    normalize divides each feature by its sample deviation over both times together, 0 taken as 1, if there is
    more than one common segment. NaN and null differences count as 0.
    """
    both, by, names = _aligned(t1, t2)
    difference = {c: F.col(f"_b_{c}") - F.col(f"_a_{c}") for c in names}
    if normalize:
        stacked = both.select(F.explode(F.array(*[F.struct(*[F.col(f"_{t}_{c}").alias(c) for c in names]) for t in "ab"])).alias("x")).select("x.*")
        # one row
        spread = stacked.agg(F.count(F.lit(1)).alias("_rows"), *(F.stddev_samp(F.nanvl(c, F.lit(None).cast("double"))).alias(f"_s_{c}") for c in names))
        both = both.join(F.broadcast(spread))
        difference = {c: d / F.when((F.col("_rows") > 2) & (F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) != 0), F.col(f"_s_{c}")).otherwise(1.0) for c, d in difference.items()}
    squares = [F.coalesce(F.nanvl(d * d, F.lit(0.0)), F.lit(0.0)) for d in difference.values()]
    return both.select(*by, F.sqrt(sum(squares[1:], squares[0]) if squares else F.lit(0.0)).alias("change_magnitude"))


def otsu_threshold(values: DataFrame, column: str) -> DataFrame:
    """threshold: the centre of the bin, of BINS equal ones, after which the variance between both sides is largest.
    With fewer than two distinct values it lies 1 above the largest, so that nothing exceeds it. One row."""
    v = F.col(column)
    ends = values.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    step = (F.col("high") - F.col("low")) / BINS
    place = F.least(F.lit(BINS - 1), F.floor(guarded((v - F.col("low")) * BINS, F.col("high") - F.col("low"))))
    counts = values.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = values.sparkSession.range(BINS).select(F.col("id").alias("bin")).join(F.broadcast(ends)).join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bins = bins.withColumn("centre", F.col("low") + step * (F.col("bin") + 0.5))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    n, weighted = F.col("n"), F.col("n") * F.col("centre")
    split = bins.select("*", F.sum(n).over(upto).alias("w1"), F.sum(n).over(after).alias("w2"), F.sum(weighted).over(upto).alias("s1"), F.sum(weighted).over(after).alias("s2"))
    between = F.col("w1") * F.col("w2") * (guarded(F.col("s1"), F.col("w1")) - guarded(F.col("s2"), F.col("w2"))) ** 2
    best = split.agg(F.max(F.struct(F.coalesce(between, F.lit(-1.0)).alias("v"), (-F.col("bin")).alias("minus"), F.col("centre").alias("centre"))).alias("best"), F.max("low").alias("low"), F.max("high").alias("high"))
    return best.select(F.when(F.col("low") < F.col("high"), F.col("best.centre")).otherwise(F.col("high") + 1).alias("threshold"))


def detect_changes(t1: DataFrame, t2: DataFrame, threshold: float | str = "otsu", normalize: bool = True) -> DataFrame:
    """changed: whether each common segment's magnitude exceeds the threshold."""
    size = change_magnitude(t1, t2, normalize)
    by = keys(t1)
    if threshold != "otsu":
        return size.select(*by, (F.col("change_magnitude") > float(threshold)).alias("changed"))
    cut = otsu_threshold(size, "change_magnitude")
    return size.join(F.broadcast(cut)).select(*by, (F.col("change_magnitude") > F.col("threshold")).alias("changed"))


def change_summary(changed: DataFrame, t1: DataFrame | None = None, t2: DataFrame | None = None) -> DataFrame:
    """One row: total_segments, changed, unchanged, pct_changed (to one place; 0 if empty), and with both tables
    mean_diff_changed, a map of each feature's mean difference over changed segments, null if there are none."""
    counts = changed.agg(F.count(F.lit(1)).alias("total_segments"), F.coalesce(F.sum(F.col("changed").cast("bigint")), F.lit(0)).alias("changed"))
    pct = F.when(F.col("total_segments") > 0, F.round(guarded(F.col("changed"), F.col("total_segments")) * 100, 1)).otherwise(0.0)
    out = counts.select("total_segments", "changed", (F.col("total_segments") - F.col("changed")).alias("unchanged"), pct.alias("pct_changed"))
    if t1 is None or t2 is None:
        return out
    names = common_features(t1, t2)
    moved = feature_difference(t1, t2).join(changed.where("changed").select(*keys(changed)), keys(changed))
    means = moved.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in names))
    as_map = F.when(F.col("n") > 0, F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))]))
    return out.join(F.broadcast(means.select(as_map.alias("mean_diff_changed"))))


def change_table(t1: DataFrame, t2: DataFrame, threshold: float | str = "otsu", normalize: bool = True) -> DataFrame:
    """change_magnitude and changed of each common segment."""
    return change_magnitude(t1, t2, normalize).join(detect_changes(t1, t2, threshold, normalize), keys(t1))

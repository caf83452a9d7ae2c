"""Random forests of tables that a task holds: each tree is grown from all rows by one task, and trees and rows stay
distributed. Splits are exact (Gini impurity, found by sorting), all nodes of a level at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import checkpointed

#: Cells of the largest table, rows by features or classes, that trees are grown from in single tasks.
CELLS = 1 << 26
#: Rows of a block that trees are asked for.
BLOCK = 1 << 17
TREES = "tree int, feature binary, threshold binary, left binary, chances binary, importance array<double>"


def grow(x: np.ndarray, rank: np.ndarray, y: np.ndarray, weights: np.ndarray, seed: list[int], tries: int, least_split: int, deepest: int | None) -> dict:
    """One tree from a draw of as many rows with replacement. rank: the order of each feature's values; weights: of the
    classes. Nodes: feature, threshold (rows of at most it go left), left (right is next to it; below 0, leaf -1 - left)."""
    draw, (n, n_features), classes = np.random.default_rng(seed), x.shape, len(weights)
    times = np.bincount(draw.integers(0, n, n), minlength=n)
    rows = np.flatnonzero(times)
    heavy, of, at = times[rows] * weights[y[rows]], y[rows], np.zeros(len(rows), np.int64)
    features, thresholds, lefts, leaves, importance, n_leaves = [], [], [], [], np.zeros(n_features), 0
    n_level, depth, first = 1, 0, 0
    while n_level:
        total = np.bincount(at * classes + of, heavy, n_level * classes).reshape(n_level, classes)
        open_ = (np.bincount(at, minlength=n_level) >= least_split) & ((total > 0).sum(1) > 1) & (deepest is None or depth < deepest)
        order, best = draw.random((n_level, n_features)).argsort(1), np.full(n_level, -np.inf)
        feature, threshold, cut = np.zeros(n_level, np.int32), np.zeros(n_level), np.zeros(n_level, np.int64)
        for j in range(n_features):
            # beyond the features to be tried only nodes that no split was found for go on
            tried = open_ if j < tries else open_ & np.isneginf(best)
            if not tried.any():
                break
            some = np.flatnonzero(tried[at])
            f = order[at[some], j]
            r = rank[rows[some], f]
            by = np.argsort(at[some] * n + r)
            some, r = some[by], r[by]
            node = at[some]
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(node)])
            sums = np.zeros((len(node) + 1, classes))
            sums[np.arange(1, len(node) + 1), of[some]] = heavy[some]
            np.cumsum(sums, axis=0, out=sums)
            left = sums[1:] - np.repeat(sums[start], size, axis=0)
            right = total[node] - left
            ends = np.r_[(node[1:] == node[:-1]) & (r[1:] > r[:-1]), False]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(ends, (left**2).sum(1) / left.sum(1) + (right**2).sum(1) / right.sum(1), -np.inf)
            most, ids = np.maximum.reduceat(score, start), node[start]
            place = np.flatnonzero(ends & (score == np.repeat(most, size)))
            _, once = np.unique(node[place], return_index=True)  # the first of equal ones
            place = place[once]
            place = place[score[place] > best[node[place]]]
            hit = node[place]
            best[hit], feature[hit], cut[hit] = score[place], order[hit, j], r[place]
            low, high = x[rows[some[place]], feature[hit]], x[rows[some[place + 1]], feature[hit]]
            middle = low + (high - low) / 2
            threshold[hit] = np.where(middle < high, middle, low)
        split = ~np.isneginf(best)
        weight = total.sum(1)
        np.add.at(importance, feature[split], np.maximum(0, best[split] - (total[split] ** 2).sum(1) / weight[split]))
        child = np.cumsum(split) - 1
        ends_here = np.cumsum(~split) - 1 + n_leaves
        features.append(feature)
        thresholds.append(threshold)
        lefts.append(np.where(split, first + n_level + 2 * child, -1 - ends_here).astype(np.int32))
        leaves.append((total[~split] / weight[~split, None]).astype(np.float32))
        n_leaves += int((~split).sum())
        on = split[at]
        rows, heavy, of, at = rows[on], heavy[on], of[on], at[on]
        at = 2 * child[at] + (rank[rows, feature[at]] > cut[at])
        first, n_level, depth = first + n_level, 2 * int(split.sum()), depth + 1
    return {
        "feature": np.concatenate(features).tobytes(), "threshold": np.concatenate(thresholds).tobytes(), "left": np.concatenate(lefts).tobytes(),
        "chances": np.concatenate(leaves).tobytes(), "importance": (importance / (importance.sum() or 1)).tolist(),
    }


def chances(tree: dict, x: np.ndarray, classes: int) -> np.ndarray:
    """Of each class for each row of x, by one tree."""
    feature, threshold, left = (np.frombuffer(tree[k], t) for k, t in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32)))
    at, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(on := on[left[at[on]] >= 0]):
        node = at[on]
        at[on] = left[node] + (x[on, feature[node]] > threshold[node])
    return np.frombuffer(tree["chances"], np.float32).reshape(-1, classes)[-1 - left[at]].astype(float)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _tries(features: int, given: str | int | float | None) -> int:
    """How many features max_features means, in the words of MLlib or as a number or share."""
    words = {"sqrt": np.sqrt(features), "log2": np.log2(features), "onethird": features / 3, "all": features, "None": features, "auto": np.sqrt(features)}
    n = words[str(given)] if str(given) in words else float(given)
    share = isinstance(given, float) and n <= 1 or isinstance(given, str) and "." in given
    return int(min(features, max(1, np.ceil(n * features if share and str(given) not in words else n))))


def _groups(df: DataFrame, trees: int) -> int:
    return min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class Forest:
    trees: DataFrame
    n_trees: int
    classes: int
    importances: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, weights: list[float], n_trees: int, tries: str | int | float | None, least_split: int, deepest: int | None, seed: int) -> Forest:
        """rows: _x (a vector), _y (the number of the class), _o (an order of the rows). Rows go once to each group of
        trees; the groups are as many as fill the cluster twice, and the trees the same however many there are."""
        groups, classes = _groups(rows, n_trees), np.array(weights)

        def grown(table: pa.Table) -> pa.Table:
            group = table["_g"][0].as_py()
            order = np.argsort(table["_o"].to_numpy(), kind="stable")
            x, y = _array(table, "_x")[order], table["_y"].to_numpy()[order].astype(np.int64)
            rank = np.empty(x.shape, np.int32)
            for k in range(x.shape[1]):
                rank[:, k] = np.unique(x[:, k], return_inverse=True)[1]
            found = [{"tree": t} | grow(x, rank, y, classes, [seed, t], _tries(x.shape[1], tries), least_split, deepest) for t in range(group, n_trees, groups)]
            return pa.Table.from_pylist(found, pa.schema([("tree", pa.int32()), *((k, pa.binary()) for k in ("feature", "threshold", "left", "chances")), ("importance", pa.list_(pa.float64()))]))

        dealt = rows.select(vector_to_array("_x").alias("_x"), "_y", "_o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
        # growing takes far longer than the rows' bytes suggest, so groups must not be put together by size
        trees = checkpointed(dealt.repartition(8 * groups, "_g").groupBy("_g").applyInArrow(grown, TREES))
        return cls.of(trees, len(weights))

    @classmethod
    def of(cls, trees: DataFrame, classes: int) -> Forest:
        each = [r[0] for r in trees.orderBy("tree").select("importance").collect()]  # a number for each tree and feature
        mean = np.mean(each, axis=0)
        return cls(trees, len(each), classes, (mean / (mean.sum() or 1)).tolist())

    def chances(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """by and _q, an array with the chance of each class, for rows of by and _x. Blocks of rows meet groups of trees."""
        kept = checkpointed(rows.select(*by, vector_to_array("_x").alias("_x"), F.monotonically_increasing_id().alias("_row")))
        groups, blocks, classes = _groups(rows, self.n_trees), max(1, -(-kept.count() // BLOCK)), self.classes
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = kept.select("_row", "_x", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_b"), all_of(groups).alias("_g"))
        trees = self.trees.select("tree", "feature", "threshold", "left", "chances", (F.col("tree") % groups).alias("_g"), all_of(blocks).alias("_b"))
        schema = pa.schema([("_row", pa.int64()), ("_g", pa.int32()), ("_p", pa.list_(pa.float64()))])

        def asked(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            if not mine.num_rows or not theirs.num_rows:
                return schema.empty_table()
            x, out = _array(mine, "_x"), np.zeros((mine.num_rows, classes))
            for t in sorted(theirs.to_pylist(), key=lambda t: t["tree"]):
                out += chances(t, x, classes)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, classes, dtype=np.int32)), pa.array(out.ravel()))
            return pa.table([mine["_row"], pa.array(np.full(len(x), theirs["_g"][0].as_py(), np.int32)), parts], schema)

        found = asks.groupBy("_g", "_b").cogroup(trees.groupBy("_g", "_b")).applyInArrow(asked, "_row bigint, _g int, _p array<double>")
        add: Column = F.aggregate(F.array_sort(F.collect_list(F.struct("_g", "_p"))), F.array_repeat(F.lit(0.0), classes), lambda s, v: F.zip_with(s, v["_p"], lambda a, b: a + b))
        total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
        sums = found.groupBy("_row").agg(add.alias("_s")).select("_row", F.transform("_s", lambda v: v / total).alias("_q"))
        return kept.select(*by, "_row").join(sums, "_row").select(*by, "_q")

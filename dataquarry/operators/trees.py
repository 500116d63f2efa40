"""Tree ensembles for large tables, grown on binned rows.

MLlib cuts every number into at most ``maxBins`` bins and sees nothing else of it, so rows in the
same bins are alike to a tree.  They are counted together here (a *cell* is one combination of bins
with its rows per class) where that shrinks the table; where it does not, boosting keeps the binned
rows in the memory of one task per core, which exchange nothing but histograms.

The rules are MLlib's: the same candidate splits, gains, leaves, losses and pruning.  A forest's bags
give every row a Poisson number of draws, so a cell of n rows gets a Poisson(n) number.  The result is
an ordinary MLlib model.  Small tables, and tables of too many cells, go to MLlib itself.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.runtime import discard, materialise, new_path, remove

# Fewer rows than this go to MLlib, whose jobs are short then.
MANY_ROWS = 100_000
# Rows whose values give the candidate splits: what MLlib takes for 256 bins.
SPLIT_ROWS = 1 << 16
# All cells are held by every task that grows a tree, and by the driver: at most so many bytes.
CELL_BYTES = 64 << 20
# Wider rows than this do not fall into few cells.
MOST_FEATURES = 256
# Rows, and numbers of a histogram, that are worked on together.
CHUNK, HELD = 1 << 16, 1 << 21
EPSILON = 2.0 ** -52
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


@dataclass(frozen=True)
class Bins:
    """Ascending thresholds of every feature; a value's code is how many of them lie below it."""

    thresholds: tuple[np.ndarray, ...]
    binary: frozenset[int]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """``features x rows``."""
        return np.stack([np.searchsorted(t, x[:, j]).astype(np.uint8) for j, t in enumerate(self.thresholds)])


@dataclass
class Tree:
    """Nodes in order of their levels; a leaf has feature -1."""

    stats: np.ndarray
    impurity: np.ndarray
    prediction: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray

    def pruned(self) -> Tree:
        """Two leaves of the same prediction become one leaf, as MLlib does it."""
        feature = self.feature.copy()
        for i in range(len(feature) - 1, -1, -1):
            if feature[i] >= 0:
                a = self.left[i]
                if feature[a] < 0 and feature[a + 1] < 0 and self.prediction[a] == self.prediction[a + 1]:
                    feature[i] = -1
        kept = np.zeros(len(feature), dtype=bool)
        kept[0] = True
        for i in range(len(feature)):
            if kept[i] and feature[i] >= 0:
                kept[self.left[i]] = kept[self.left[i] + 1] = True
        at = np.cumsum(kept) - 1
        return Tree(
            self.stats[kept], self.impurity[kept], self.prediction[kept], feature[kept], self.cut[kept], self.gain[kept],
            np.where(feature >= 0, at[np.minimum(self.left, len(at) - 1)], -1)[kept],
        )

    def table(self, number: int, bins: Bins, counts: np.ndarray) -> pa.RecordBatch:
        """The nodes as MLlib saves them; ``counts`` are their rows."""
        n, inner = len(self.feature), self.feature >= 0
        lists = []
        for f, c in zip(self.feature, self.cut):
            lists.append([] if f < 0 else [0.0] if f in bins.binary else [float(bins.thresholds[f][c])])
        split = pa.StructArray.from_arrays(
            [
                pa.array(self.feature.astype(np.int32)), pa.array(lists, pa.list_(pa.float64())),
                pa.array(np.where(np.isin(self.feature, list(bins.binary)), 2, -1).astype(np.int32)),
            ],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        node = pa.StructArray.from_arrays(
            [
                pa.array(np.arange(n, dtype=np.int32)), pa.array(self.prediction), pa.array(self.impurity),
                pa.array(list(self.stats), pa.list_(pa.float64())), pa.array(np.rint(counts).astype(np.int64)),
                pa.array(np.where(inner, self.gain, -1.0)),
                pa.array(np.where(inner, self.left, -1).astype(np.int32)), pa.array(np.where(inner, self.left + 1, -1).astype(np.int32)),
                split,
            ],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
        )
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, dtype=np.int32)), node], ["treeID", "nodeData"])


def candidate_splits(values: np.ndarray, max_bins: int) -> np.ndarray:
    """MLlib's thresholds of one feature: between distinct values, at even shares of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= min(max_bins, len(values)):
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride = len(values) / min(max_bins, len(values))
    reached = np.cumsum(counts)
    out, target = [], stride
    for i in range(1, len(distinct)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(out)


def binary_features(df: DataFrame, features: str) -> set[int] | None:
    """Features declared to be 0 or 1; None if some have more categories."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if attrs.get("nominal"):
        return None
    return {a["idx"] for a in attrs.get("binary", [])}


# ---------------------------------------------------------------- forests


def _gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1)
    share = counts / np.where(total > 0, total, 1.0)[..., None]
    return np.where(total > 0, 1.0 - (share * share).sum(axis=-1), 0.0)


def _best_gini(hist: np.ndarray, impurity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cut of the best split of ``nodes x bins x classes``; no gain where a side is empty."""
    left = hist.cumsum(axis=1)
    total = left[:, -1:, :]
    left, right = left[:, :-1], total - left[:, :-1]
    n, a, b = total.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    gain = impurity[:, None] - a / n * _gini(left) - b / n * _gini(right)
    gain[(a == 0) | (b == 0)] = -np.inf
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def grow_class_tree(codes: np.ndarray, counts: np.ndarray, bins: Bins, subset: int, depth: int, rng: np.random.Generator) -> Tree:
    """One tree of a random forest on a bag of the cells: ``codes`` (features x cells), ``counts`` (cells x classes)."""
    weights = rng.poisson(counts).astype(float)
    drawn = weights.sum(axis=1) > 0
    codes, weights = codes[:, drawn], weights[drawn]
    node = np.zeros(len(weights), dtype=np.int64)
    levels: list[dict[str, np.ndarray]] = []
    stats, first = weights.sum(axis=0)[None, :], 0
    for level in range(depth + 1):
        m = len(stats)
        impurity = _gini(stats)
        gain, cut, feature = np.full(m, -np.inf), np.zeros(m, dtype=np.int64), np.full(m, -1)
        grows = impurity >= EPSILON if level < depth else np.zeros(m, dtype=bool)
        if grows.any():
            # Cells of leaves leave; the others lie in the order of their nodes.
            keep = grows[node]
            node, weights, codes = node[keep], weights[keep], codes[:, keep]
            order = np.argsort(node, kind="stable")
            node, weights, codes = node[order], weights[order], codes[:, order]
            chosen = np.zeros((m, len(codes)), dtype=bool)
            np.put_along_axis(chosen, rng.random((m, len(codes))).argpartition(subset - 1, axis=1)[:, :subset], True, axis=1)
            widest = max(len(t) for t in bins.thresholds) + 1
            step = max(1, HELD // (widest * weights.shape[1]))
            for begin in range(0, m, step):
                lo, hi = np.searchsorted(node, [begin, begin + step])
                if lo == hi:
                    continue
                for j, thresholds in enumerate(bins.thresholds):
                    nodes = np.flatnonzero(chosen[begin:begin + step, j] & grows[begin:begin + step]) + begin
                    if not len(thresholds) or not len(nodes):
                        continue
                    local = np.full(min(step, m - begin), -1)
                    local[nodes - begin] = np.arange(len(nodes))
                    at = local[node[lo:hi] - begin]
                    mine = at >= 0
                    width = len(thresholds) + 1
                    place = at[mine] * width + codes[j, lo:hi][mine]
                    hist = np.stack([
                        np.bincount(place, w, len(nodes) * width).reshape(len(nodes), width) for w in weights[lo:hi][mine].T
                    ], axis=-1)
                    found, where = _best_gini(hist, impurity[nodes])
                    better = found > gain[nodes]
                    gain[nodes[better]], cut[nodes[better]], feature[nodes[better]] = found[better], where[better], j
        split = gain > 0
        feature[~split] = -1
        left = np.where(split, first + m + 2 * (np.cumsum(split) - 1), -1)
        levels.append({"stats": stats, "impurity": impurity, "feature": feature, "cut": cut, "gain": gain, "left": left})
        if not split.any():
            break
        keep = split[node]
        node, weights, codes = node[keep], weights[keep], codes[:, keep]
        right = codes[feature[node], np.arange(len(node))] > cut[node]
        node = left[node] - first - m + right
        first, m = first + m, 2 * int(split.sum())
        stats = np.stack([np.bincount(node, w, m) for w in weights.T], axis=1)
    found = {k: np.concatenate([x[k] for x in levels]) for k in levels[0]}
    return Tree(prediction=found["stats"].argmax(axis=1).astype(float), **found).pruned()


# ---------------------------------------------------------------- boosting


def grow_boosted(
    codes: np.ndarray, label: np.ndarray, weight: np.ndarray | None, bins: Bins, rounds: int, depth: int, step: float
) -> list[Tree]:
    """Gradient boosting with the logistic loss: ``codes`` (features x rows), ``label`` 0 or 1, ``weight`` of the rows.

    Features of one threshold lie eight to a byte, so that a histogram over the bytes covers them.
    """
    n = len(label)
    two = [j for j, t in enumerate(bins.thresholds) if len(t) == 1]
    many = [j for j, t in enumerate(bins.thresholds) if len(t) > 1]
    packed = [np.packbits(codes[two[i:i + 8]], axis=0, bitorder="little")[0] for i in range(0, len(two), 8)]
    columns = [codes[j] for j in many] + packed
    bit = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1 == 0).astype(float)
    sign = label * 2.0 - 1.0
    margin = np.zeros(n)
    chunks = [slice(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK)]
    trees: list[Tree] = []
    for turn in range(rounds):
        target = sign if turn == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        node = np.zeros(n, dtype=np.int64)  # in its level; m where the row's leaf lies above
        levels: list[dict[str, np.ndarray]] = []
        leaf = np.zeros(n, dtype=np.int64)
        m, first = 1, 0
        for level in range(depth + 1):
            last = level == depth
            sums = np.zeros((3, m + 1))
            hist = np.zeros((2, 0 if last else len(columns), (m + 1) * 256))
            for c in chunks:
                at, t = node[c], target[c]
                w = None if weight is None else weight[c]
                wt = t if w is None else w * t
                sums[0] += np.bincount(at, w, m + 1)
                sums[1] += np.bincount(at, wt, m + 1)
                sums[2] += np.bincount(at, wt * t, m + 1)
                base = at * 256
                for i in range(hist.shape[1]):
                    place = base + columns[i][c]
                    hist[0, i] += np.bincount(place, w, (m + 1) * 256)
                    hist[1, i] += np.bincount(place, wt, (m + 1) * 256)
            sums, hist = sums[:, :m], hist.reshape(2, -1, m + 1, 256)[:, :, :m]
            count, mean = sums[0], sums[1] / np.maximum(sums[0], EPSILON)
            impurity = np.maximum(sums[2] / np.maximum(count, EPSILON) - mean * mean, 0.0)
            gain, cut, feature = np.full(m, -np.inf), np.zeros(m, dtype=np.int64), np.full(m, -1)
            if not last:
                own = np.where(count > 0, sums[1] ** 2 / np.maximum(count, EPSILON), 0.0)
                lefts = [(j, hist[:, i, :, : len(bins.thresholds[j]) + 1].cumsum(axis=-1)[:, :, :-1]) for i, j in enumerate(many)]
                lefts += [(j, (hist[:, len(many) + i // 8] @ bit)[:, :, i % 8, None]) for i, j in enumerate(two)]
                for j, (a, s) in sorted(lefts, key=lambda x: x[0]):
                    b, r = count[:, None] - a, sums[1][:, None] - s
                    empty = (a < 0.5) | (b < 0.5)
                    score = (s * s / np.where(empty, 1.0, a) + r * r / np.where(empty, 1.0, b) - own[:, None]) / np.maximum(count, EPSILON)[:, None]
                    score[empty] = -np.inf
                    where = score.argmax(axis=1)
                    found = score[np.arange(m), where]
                    better = found > gain
                    gain[better], cut[better], feature[better] = found[better], where[better], j
            split = (gain > 0) & (impurity >= EPSILON)
            feature[~split] = -1
            left = np.where(split, first + m + 2 * (np.cumsum(split) - 1), -1)
            levels.append({
                "stats": np.stack([count, sums[1], sums[2]], axis=1), "impurity": impurity, "prediction": mean,
                "feature": feature, "cut": cut, "gain": gain, "left": left,
            })
            after = 2 * int(split.sum())
            child = np.append(np.where(split, left - first - m, after), after)
            ask, bound, here = np.append(np.maximum(feature, 0), 0), np.append(np.where(split, cut, 256), 256), np.append(np.arange(m) + first, -1)
            for c in chunks:
                at = node[c]
                if not split.all():
                    ends = child[at] == after
                    mine = ends & (at < m)
                    leaf[c][mine] = here[at[mine]]
                node[c] = child[at] + (codes[:, c][ask[at], np.arange(len(at))] > bound[at])
            first, m = first + m, after
            if not after:
                break
        grown = Tree(**{k: np.concatenate([x[k] for x in levels]) for k in levels[0]})
        margin += (1.0 if turn == 0 else step) * grown.prediction[leaf]
        trees.append(grown.pruned())
    return trees


# ---------------------------------------------------------------- cells and models


def _binned(df: DataFrame, features: str, label: str, bins: Bins) -> DataFrame:
    """``(code, label)``: the bins of a row, a byte each."""
    width = len(bins.thresholds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                code = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(width), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(bins.codes(x).T).tobytes())]
                )
                yield pa.RecordBatch.from_arrays([code.cast(pa.binary()), batch.column(1)], ["code", "label"])

    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("int").alias("label"))
    return rows.mapInArrow(encode, "code binary, label int")


def _matrix(codes: pa.ChunkedArray, width: int) -> np.ndarray:
    """``features x rows`` of the bytes of ``codes``."""
    parts = [np.stack([np.frombuffer(x, np.uint8) for x in c.to_pylist()]) if len(c) else np.empty((0, width), np.uint8) for c in codes.chunks]
    return np.ascontiguousarray(np.concatenate(parts).T) if parts else np.empty((width, 0), np.uint8)


@dataclass
class Binned:
    """A training table in bins: its cells, or None if they are too many to hold."""

    df: DataFrame
    rows: int
    classes: int
    bins: Bins
    cells: tuple[np.ndarray, np.ndarray] | None


def bin_rows(df: DataFrame, features: str, label: str, max_bins: int, seed: int) -> Binned | None:
    """None for tables that MLlib should take as they are."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("top"), F.min(label).alias("least"), F.max(F.ceil(label) - F.col(label)).alias("part")).first()
    binary = binary_features(df, features)
    n = found["n"]
    if n < MANY_ROWS or binary is None or max_bins > 256 or found["least"] < 0 or found["part"] > 0 or found["top"] > 100:
        return None
    width = df.select(F.size(vector_to_array(F.col(features))).alias("d")).first()["d"]
    if width > MOST_FEATURES:
        return None
    classes = int(found["top"]) + 1
    few = df.sample(False, min(1.0, SPLIT_ROWS / n), seed) if n > SPLIT_ROWS else df
    x = few.select(vector_to_array(F.col(features)).alias("x")).toArrow().column(0)
    x = x.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not len(x):
        return None
    cuts = tuple(np.array([0.5]) if j in binary else candidate_splits(x[:, j], max_bins) for j in range(width))
    bins = Bins(cuts, frozenset(binary))
    most = CELL_BYTES // (width + 8 * classes)
    # Rows that share their cell even in the sample tell that the table has few of them.
    distinct = len(np.unique(bins.codes(x), axis=1).T)
    if n > SPLIT_ROWS and (len(x) - distinct) * 2 * most < len(x) * len(x):
        return Binned(df, n, classes, bins, None)
    counts = [F.sum((F.col("label") == k).cast("bigint")).alias(f"n{k}") for k in range(classes)]
    cells = materialise(_binned(df, features, label, bins).groupBy("code").agg(*counts), "cells")
    size = cells.count()
    out = None
    if size <= most:
        # In the order of their codes, so that a seed gives the same trees however rows lie.
        table = cells.orderBy("code").toArrow()
        out = _matrix(table.column("code"), width), np.stack([table.column(f"n{k}").to_numpy() for k in range(classes)], axis=1)
    discard(cells)
    return Binned(df, n, classes, bins, out)


def _load(spark, estimator, kind, tree_kind: str, nodes: DataFrame, weights: list[float], **numbers):
    """The MLlib model whose trees are ``nodes``, by way of its saved form."""
    path = new_path(spark, "model")
    nodes.write.parquet(f"{path}/data")
    name = kind.__name__
    told = {p.name: v for p, v in estimator._paramMap.items()}
    usual = {p.name: v for p, v in estimator._defaultParamMap.items()}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "paramMap": told, "defaultParamMap": usual}
    package = "org.apache.spark.ml"
    whole = head | {"class": f"{package}.classification.{name}", "uid": estimator.uid, "numTrees": len(weights)} | numbers
    own = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
           "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "leafCol"}
    single = head | {k: {p: v for p, v in head[k].items() if p in own} for k in ("paramMap", "defaultParamMap")}
    trees = [(i, json.dumps(single | {"class": f"{package}.{tree_kind}", "uid": f"{estimator.uid}_{i}"}), w) for i, w in enumerate(weights)]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = kind.load(path)
    remove(spark, path)
    return model


def _cores(spark) -> int:
    return spark.sparkContext.defaultParallelism


class BinnedForest(RandomForestClassifier):
    """MLlib's random forest; where the cells of a large table can be held, they are grown tree by tree on all cores."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        found = bin_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins(), self.getSeed())
        if found is None or found.cells is None or found.classes < 2:
            return super()._fit(dataset)
        spark = dataset.sparkSession
        shared = spark.sparkContext.broadcast((found.cells, found.bins))
        width = len(found.bins.thresholds)
        subset, depth, seed, trees = max(1, math.ceil(math.sqrt(width))), self.getMaxDepth(), self.getSeed(), self.getNumTrees()

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (codes, counts), bins = shared.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    tree = grow_class_tree(codes, counts, bins, subset, depth, np.random.default_rng([seed, i]))
                    yield tree.table(i, bins, tree.stats.sum(axis=1))

        nodes = spark.range(0, trees, 1, min(trees, 4 * _cores(spark))).mapInArrow(grow, NODES)
        model = _load(
            spark, self, RandomForestClassificationModel, "classification.DecisionTreeClassificationModel", nodes, [1.0] * trees,
            numFeatures=width, numClasses=found.classes,
        )
        shared.destroy()
        return model


class BinnedBoosting(GBTClassifier):
    """MLlib's boosted trees for two classes; where the cells of a large table can be held, one task boosts them."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        found = bin_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getMaxBins(), self.getSeed())
        if found is None or found.cells is None or found.classes != 2:
            return super()._fit(dataset)
        spark = dataset.sparkSession
        rounds, depth, step, bins = self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), found.bins
        codes, counts = found.cells
        at, label = np.nonzero(counts)
        shared = spark.sparkContext.broadcast((np.ascontiguousarray(codes[:, at]), label.astype(float), counts[at, label].astype(float)))

        def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _ in range(batch.num_rows):
                    for i, tree in enumerate(grow_boosted(*shared.value, bins, rounds, depth, step)):
                        yield tree.table(i, bins, tree.stats[:, 0])

        nodes = spark.range(0, 1, 1, 1).mapInArrow(boost, NODES)
        model = self._model(spark, nodes, rounds, len(bins.thresholds))
        shared.destroy()
        return model

    def _model(self, spark, nodes: DataFrame, rounds: int, width: int) -> GBTClassificationModel:
        weights = [1.0] + [self.getStepSize()] * (rounds - 1)
        return _load(spark, self, GBTClassificationModel, "regression.DecisionTreeRegressionModel", nodes, weights, numFeatures=width)

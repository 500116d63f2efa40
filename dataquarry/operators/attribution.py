"""Exact Shapley values of tree ensembles, each tree conditioned on its own training counts.

A model is flattened into leaves.  A leaf is reached if, for every feature on its path, the
row's value meets the leaf's condition on that feature; a feature that is not known is met
with the share of training rows that took those branches.  So a leaf with m features is a
game of m players with 2^m outcomes at most: the rows of a batch fall into a few patterns of
met conditions, and the Shapley values of a pattern are computed once.

Leaves travel to the tasks as one broadcast, which is as large as the model; rows move only if
some cores would have far more of them than others, and a batch is all that a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.runtime import balance, new_path


@dataclass(frozen=True)
class Condition:
    """``low < x <= high`` (not a number counts as larger than any), and one of ``values`` if there are any."""

    feature: int
    low: float = -np.inf
    high: float = np.inf
    values: frozenset | None = None

    def met(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        if self.values is not None:
            return np.isin(v, list(self.values))
        return ~(v <= self.low) & ((v <= self.high) | np.isinf(self.high))

    def and_left(self, split) -> Condition:
        if split["numCategories"] >= 0:
            left = frozenset(split["leftCategoriesOrThreshold"])
            return Condition(self.feature, values=left if self.values is None else self.values & left)
        return Condition(self.feature, self.low, min(self.high, split["leftCategoriesOrThreshold"][0]))

    def and_right(self, split) -> Condition:
        if split["numCategories"] >= 0:
            every = frozenset(map(float, range(split["numCategories"])))
            return Condition(self.feature, values=(every if self.values is None else self.values) - frozenset(split["leftCategoriesOrThreshold"]))
        return Condition(self.feature, max(self.low, split["leftCategoriesOrThreshold"][0]), self.high)


@dataclass(frozen=True)
class Leaf:
    """Conditions with the share of training rows that meet each, and the value per output."""

    conditions: tuple[Condition, ...]
    shares: np.ndarray
    values: np.ndarray


def _members(model) -> list:
    """The binary or regression ensembles that make up a model: one per class for one-vs-rest."""
    return list(model.models) if hasattr(model, "models") else [model]


def flatten(spark, model) -> list[Leaf]:
    """The leaves of a fitted MLlib tree ensemble, weighted so that their values add up to the model's output.

    The output is the margin of boosted trees (per class for one-vs-rest), the class
    probabilities of a forest, or the predicted number.  Trees are read from the model as it is saved.
    """
    members = _members(model)
    leaves: list[Leaf] = []
    for output, member in enumerate(members):
        if not hasattr(member, "trees"):
            raise ValueError("attribution needs a linear model or a tree ensemble")
        path = new_path(spark, "attribution-model")
        member.write().overwrite().save(path)
        trees: dict[int, dict[int, dict]] = {}
        for r in spark.read.parquet(f"{path}/data").collect():
            trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
        votes = len(members) == 1 and "Forest" in type(member).__name__ and hasattr(member, "numClasses")
        weights = [1.0 / len(trees)] * len(trees) if "Forest" in type(member).__name__ else member.treeWeights

        def value(node: dict, weight: float) -> np.ndarray:
            if votes:
                stats = np.asarray(node["impurityStats"], float)
                return weight * stats / stats.sum()
            out = np.zeros(len(members))
            out[output] = weight * node["prediction"]
            return out

        def weight_of(node: dict) -> float:
            """Training rows of a node: the first of the moments of a number, or all classes."""
            stats = node["impurityStats"]
            return sum(stats) if votes else stats[0]

        for tree, nodes in trees.items():
            open_ = [(0, {}, {})]
            while open_:
                at, conditions, shares = open_.pop()
                node = nodes[at]
                if node["leftChild"] < 0:
                    used = sorted(conditions)
                    leaves.append(Leaf(tuple(conditions[f] for f in used), np.array([shares[f] for f in used]), value(node, weights[tree])))
                    continue
                split = node["split"]
                feature = split["featureIndex"]
                before = conditions.get(feature, Condition(feature))
                for child, after in ((node["leftChild"], before.and_left(split)), (node["rightChild"], before.and_right(split))):
                    share = weight_of(nodes[child]) / weight_of(node)
                    open_.append((child, {**conditions, feature: after}, {**shares, feature: shares.get(feature, 1.0) * share}))
    return leaves


def pattern_values(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1, for every row of ``met`` (patterns x features).

    For feature j: ``(met_j - share_j) * sum_k k! (m-1-k)! / m! * c_k``, where ``c_k`` are the
    coefficients of the product of ``share_i + met_i t`` over the other features.
    """
    rows, m = met.shape
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for j in range(m):
        c = np.zeros((rows, m))
        c[:, 0] = 1.0
        for i in range(m):
            if i != j:
                raised = np.zeros_like(c)
                raised[:, 1:] = c[:, :-1] * met[:, i : i + 1]
                c = c * shares[i] + raised
        out[:, j] = (met[:, j] - shares[j]) * (c @ weight)
    return out


# A leaf of so many features has a table of the values of all its patterns.
TABLE_FEATURES = 6


def leaf_tables(leaves: Sequence[Leaf]) -> list[np.ndarray | None]:
    """Per leaf the values of every pattern, numbered by its bits; None for leaves of many features."""
    out: list[np.ndarray | None] = []
    for leaf in leaves:
        m = len(leaf.conditions)
        patterns = (np.arange(1 << m)[:, None] >> np.arange(m)[None, :] & 1).astype(float) if 0 < m <= TABLE_FEATURES else None
        out.append(None if patterns is None else np.ascontiguousarray(pattern_values(patterns, leaf.shares).T))
    return out


def shapley_values(x: np.ndarray, leaves: Sequence[Leaf], tables: Sequence[np.ndarray | None] | None = None) -> np.ndarray:
    """``rows x outputs x features``; ``tables`` hands over the leaves' tables for many calls."""
    tables = leaf_tables(leaves) if tables is None else tables
    out = np.zeros((len(leaves[0].values), x.shape[1], len(x)))
    met: dict[Condition, np.ndarray] = {}
    for leaf, table in zip(leaves, tables):
        if not leaf.conditions:
            continue
        for c in leaf.conditions:
            if c not in met:
                met[c] = c.met(x).astype(np.uint8)
        columns = [c.feature for c in leaf.conditions]
        if table is not None:
            which = met[leaf.conditions[0]].astype(np.intp)
            for i, c in enumerate(leaf.conditions[1:], 1):
                which |= met[c] << np.uint8(i)
        else:
            rows = np.column_stack([met[c] for c in leaf.conditions])
            _, first, which = np.unique(np.packbits(rows, axis=1), axis=0, return_index=True, return_inverse=True)
            which, table = which.ravel(), pattern_values(rows[first].astype(float), leaf.shares).T
        for output in np.flatnonzero(leaf.values):
            for column, values in zip(columns, table):
                out[output, column] += (leaf.values[output] * values)[which]
    return out.transpose(2, 0, 1)


def expected_output(leaves: Sequence[Leaf]) -> np.ndarray:
    """The mean output over the rows that each tree was trained on."""
    return sum(leaf.values * leaf.shares.prod() for leaf in leaves)


#: Rows whose values are computed together.
ROWS = 8192


def tree_contributions(df: DataFrame, key: str, model, features: str = "features") -> DataFrame:
    """``(key, output, expected, contributions)``: a row for every row and output of the model.

    ``expected`` plus the sum of ``contributions`` is the model's output for the row.
    """
    spark = df.sparkSession
    leaves = flatten(spark, model)
    base = np.atleast_1d(expected_output(leaves))
    shared = spark.sparkContext.broadcast(leaves)
    kind = df.schema[key].dataType.simpleString()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = leaf_tables(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                phi = np.ascontiguousarray(shapley_values(x, shared.value, tables))
                rows, outputs, width = phi.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows * outputs + 1, dtype=np.int32) * width), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(rows), outputs))), pa.array(np.tile(np.arange(outputs, dtype=np.int32), rows)),
                        pa.array(np.tile(base, rows)), lists,
                    ],
                    ["key", "output", "expected", "contributions"],
                )

    rows = balance(df.select(F.col(key).alias("key"), vector_to_array(F.col(features)).alias("x")), "attributed")
    found = rows.mapInArrow(values, f"key {kind}, output int, expected double, contributions array<double>")
    return found.withColumnRenamed("key", key)


def tree_attribution(df: DataFrame, key: str, model, names: Sequence[str]) -> DataFrame:
    """``(feature, mean_abs)``: mean absolute contribution over all rows, added up over the outputs."""
    table = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string")
    each = tree_contributions(df, key, model).select("output", F.posexplode("contributions").alias("i", "v"))
    mean = each.groupBy("output", "i").agg(F.avg(F.abs("v")).alias("v")).groupBy("i").agg(F.sum("v").alias("mean_abs"))
    return mean.join(table, "i").select("feature", "mean_abs")

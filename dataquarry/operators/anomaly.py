"""Isolation forest (Liu, Ting and Zhou, 2008): trees grown and rows scored in Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.hashing import HASH_SPACE, key_hash
from dataquarry.operators.columns import col, numeric_columns
from dataquarry.operators.ordered import quantiles_of
from dataquarry.runtime import balance, materialise

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
EULER = 0.5772156649

_NODES = "tree int, feature array<int>, split array<double>, left array<int>, right array<int>, length array<double>"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One isolation tree over at most a sample of points, as flat node lists."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "split", "left", "right", "length")}
    todo = [(points, 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = me
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(hi > lo)
        leaf = depth >= limit or len(rows) <= 1 or not len(varied)
        f = -1 if leaf else int(rng.choice(varied))
        at = 0.0 if leaf else float(rng.uniform(lo[f], hi[f]))
        # A draw on the lower end would leave one side empty.
        at = float(hi[f]) if not leaf and at <= lo[f] else at
        for k, v in (("feature", f), ("split", at), ("left", me), ("right", me), ("length", depth + average_path(len(rows)))):
            nodes[k].append(v)
        if not leaf:
            below = rows[:, f] < at
            todo.append((rows[below], depth + 1, me, "left"))
            todo.append((rows[~below], depth + 1, me, "right"))
    return nodes


def _tree_samples(df: DataFrame, key: str, columns: Sequence[str], trees: int, sample: int) -> tuple[DataFrame, int]:
    """``(tree, x)`` rows, at most ``sample`` per tree, and the sample size in use."""
    n = df.count()
    psi = min(sample, n)
    x = F.array(*[col(c).cast("double") for c in columns]).alias("x")
    pool_size = 2 * trees * sample
    rows = df.select(F.col(key).alias("k"), x)
    if n > pool_size:
        # A hash threshold keeps about two samples per tree; every kept row serves one tree.
        rows = rows.filter(key_hash(F.col("k"), "pool") < int(HASH_SPACE * pool_size / n))
        rows = rows.withColumn("tree", F.pmod(F.xxhash64("k", F.lit("tree")), F.lit(trees)).cast("int"))
    else:
        # Fewer rows than that: each row serves as many trees, picked by its hash, as it takes.
        serves = min(trees, math.ceil(pool_size / max(n, 1)))
        shuffled = F.array_sort(
            F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("k", t).alias("h"), t.alias("t")))
        )
        rows = rows.withColumn("tree", F.explode(F.transform(F.slice(shuffled, 1, serves), lambda s: s["t"])))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("k", "tree"), "k")
    picked = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= psi)
    return picked.select("tree", "x"), psi


def fit_isolation_forest(
    df: DataFrame, key: str, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> tuple[list, int]:
    """Grow the trees, one group of at most ``sample`` rows per tree; returns nodes and sample size."""
    picked, psi = _tree_samples(df, key, columns, trees, sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.stack(pdf["x"].to_numpy()).astype(float)
        points = points[np.lexsort(points.T)]  # the order rows arrive in must not matter
        nodes = _grow(points, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{k: [v] for k, v in nodes.items()}})

    return picked.groupBy("tree").applyInPandas(grow, _NODES).orderBy("tree").collect(), psi


def score_isolation_forest(df: DataFrame, columns: Sequence[str], forest: list, psi: int, out: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score ``2 ** (-E[path] / c(psi))``.  The forest is at most trees x 2 x sample nodes."""
    spark = df.sparkSession
    flat = [tuple(np.asarray(t[k]) for k in ("feature", "split", "left", "right", "length")) for t in forest]
    shared = spark.sparkContext.broadcast(flat)
    scale = average_path(psi) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        points = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 1))
        total = np.zeros(len(points))
        every = np.arange(len(points))
        for feature, split, left, right, length in shared.value:
            at = np.zeros(len(points), dtype=int)
            while True:
                f = feature[at]
                moving = f >= 0
                if not moving.any():
                    break
                below = points[every, np.where(moving, f, 0)] < split[at]
                at = np.where(moving, np.where(below, left[at], right[at]), at)
            total += length[at]
        return pd.Series(np.exp2(-total / len(shared.value) / scale))

    return df.withColumn(out, score(F.array(*[col(c).cast("double") for c in columns])))


def isolation_forest(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    label: str = "__anomaly_label__",
) -> DataFrame:
    """Add ``label``: -1 above the exact ``1 - contamination`` quantile of the score, else 1.

    Without numeric columns every row is an inlier.
    """
    columns = numeric_columns(df, exclude=[key]) if columns is None else list(columns)
    if not columns:
        return df.withColumn(label, F.lit(1))
    forest, psi = fit_isolation_forest(df, key, columns, trees)
    if not forest:
        raise ValueError("the table is empty")
    # Written once: the cut needs two more scans of the score, and scoring runs in Python.
    scored = materialise(score_isolation_forest(balance(df, "scored-rows"), columns, forest, psi, "_score"), "anomaly")
    cut = quantiles_of(scored.select("_score"), ["_score"], [1.0 - contamination])["_score"][0]
    return scored.withColumn(label, F.when(F.col("_score") > cut, -1).otherwise(1)).drop("_score")

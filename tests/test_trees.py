"""Trees grown on binned rows against MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassificationModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dataquarry.operators import attribution as A
from dataquarry.operators import supervised as M
from dataquarry.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    """3000 rows: two numbers, one of 12 values, and three indicators."""
    rng = np.random.default_rng(7)
    a, b, k = rng.normal(size=3000), rng.integers(0, 12, 3000), rng.integers(0, 3, 3000)
    label = (a + 0.3 * b + (k == 1) + rng.normal(size=3000) > 2).astype(float)
    table = spark.createDataFrame(
        [(i, float(round(a[i], 1)), float(b[i]), float(k[i]), float(label[i])) for i in range(3000)], "id int, a double, b double, k double, label double"
    )
    coded = OneHotEncoder(inputCol="k", outputCol="o", dropLast=False).fit(table).transform(table)
    found = VectorAssembler(inputCols=["a", "b", "o"], outputCol="features").transform(coded).select("id", "features", "label")
    return found.repartition(2).persist()


@pytest.mark.parametrize("cell_bytes", [T.CELL_BYTES, 0])
def test_boosting_is_that_of_mllib(spark, rows, monkeypatch, cell_bytes):
    """On cells, and by MLlib itself where they cannot be held."""
    monkeypatch.setattr(T, "MANY_ROWS", 0)
    monkeypatch.setattr(T, "CELL_BYTES", cell_bytes)
    estimator = M.gradient_boosting("classification", rounds=4, max_depth=3)
    assert (T.bin_rows(rows, "features", "label", 256, 1).cells is None) == (cell_bytes == 0)
    mine = estimator.fit(rows)
    plain = GBTClassifier(**{p.name: v for p, v in estimator._paramMap.items()}).fit(rows)
    margin = lambda m: m.transform(rows).select("id", vector_to_array("rawPrediction")[1].alias("v"))
    both = margin(mine).join(margin(plain).withColumnRenamed("v", "w"), "id")
    assert both.where(F.abs(F.col("v") - F.col("w")) > 1e-9).count() == 0
    assert mine.getNumTrees == 4 and mine.treeWeights == plain.treeWeights and mine.getMaxDepth() == 3
    # Leaves carry the rows, not the cells, that they were grown on.
    assert np.allclose(A.expected_output(A.flatten(spark, mine)), A.expected_output(A.flatten(spark, plain)))


class Everything:
    """Draws every row once and looks at all features."""

    def poisson(self, counts):
        return counts

    def random(self, shape):
        return np.zeros(shape)


def test_class_tree_is_that_of_mllib(rows, monkeypatch):
    monkeypatch.setattr(T, "MANY_ROWS", 0)
    found = T.bin_rows(rows, "features", "label", 32, 1)
    codes, counts = found.cells
    assert counts.sum() == 3000 and 2 * counts.shape[0] <= 3000
    tree = T.grow_class_tree(codes, counts, found.bins, len(codes), 6, Everything())
    plain = DecisionTreeClassifier(maxDepth=6, maxBins=32).fit(rows)
    x = np.array([r["x"] for r in rows.select(vector_to_array("features").alias("x")).collect()])
    code, at = found.bins.codes(x), np.zeros(len(x), dtype=int)
    for _ in range(6):
        inner = tree.feature[at] >= 0
        step = tree.left[at] + (code[tree.feature[at], np.arange(len(x))] > tree.cut[at])
        at = np.where(inner, step, at)
    expected = np.array([r["p"] for r in plain.transform(rows).select(vector_to_array("probability").alias("p")).collect()])
    got = tree.stats[at] / tree.stats[at].sum(axis=1, keepdims=True)
    assert np.allclose(got, expected) and len(tree.feature) == plain.numNodes


def test_forest_on_cells(spark, rows, monkeypatch, tmp_path):
    small = M.forest("classification", trees=10, max_depth=8).fit(rows)
    monkeypatch.setattr(T, "MANY_ROWS", 0)
    mine = M.forest("classification", trees=10, max_depth=8).fit(rows)
    right = lambda m: m.transform(rows).where("prediction = label").count()
    assert mine.getNumTrees == 10 and mine.numClasses == 2 and mine.numFeatures == 5
    assert abs(right(mine) - right(small)) < 90
    # The same cells give the same forest, wherever their rows lie.
    again = M.forest("classification", trees=10, max_depth=8).fit(rows.repartition(7))
    assert again.toDebugString.split("\n", 1)[1] == mine.toDebugString.split("\n", 1)[1]
    mine.write().save(f"{tmp_path}/m")
    assert RandomForestClassificationModel.load(f"{tmp_path}/m").getMaxDepth() == 8


def test_candidate_splits():
    assert T.candidate_splits(np.array([1.0, 2.0, 2.0, 5.0]), 32).tolist() == [1.5, 3.5]
    many = T.candidate_splits(np.arange(1000.0), 10)
    assert len(many) == 9 and abs(many[0] - 99.5) < 1


def test_patterns_of_a_leaf_are_valued_once(monkeypatch):
    """Leaves of few features have a table, and it says what the patterns met would give."""
    rng = np.random.default_rng(3)
    leaves = []
    for m in (1, 3, 6, 8):
        conditions = tuple(A.Condition(j, low=float(rng.normal())) for j in range(m))
        leaves.append(A.Leaf(conditions, rng.random(m), rng.normal(size=2)))
    x = rng.normal(size=(500, 9))
    tables = A.leaf_tables(leaves)
    assert [t is not None for t in tables] == [True, True, True, False]
    plain = A.shapley_values(x, leaves, [None] * 4)
    calls, one = [], A.pattern_values
    monkeypatch.setattr(A, "pattern_values", lambda met, shares: calls.append(len(shares)) or one(met, shares))
    assert np.allclose(A.shapley_values(x, leaves, tables), plain) and calls == [8]

"""Shapley values of tree ensembles against the definition."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from dataquarry.operators import attribution as A
from dataquarry.operators import supervised as M
from dataquarry.operators.supervised import feature_attribution, linear_attribution, linear_regressor


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 3, 300), rng.normal(size=300), rng.random(300) < 0.4]).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 3] > 0.5).astype(float) + (x[:, 2] > 1)
    table = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, x array<double>, label double")
    return table.withColumn("features", array_to_vector("x")).cache()


def plain_values(tree_paths, x):
    """Shapley values by the definition: over all subsets of known features."""
    d = len(x)

    def game(known):
        return sum(
            leaf.values * np.prod([(c.met(x[None])[0] if c.feature in known else s) for c, s in zip(leaf.conditions, leaf.shares)]) for leaf in tree_paths
        )

    phi = np.zeros((len(tree_paths[0].values), d))
    for j in range(d):
        for k in range(d):
            for known in combinations([i for i in range(d) if i != j], k):
                phi[:, j] += factorial(k) * factorial(d - 1 - k) / factorial(d) * (game({*known, j}) - game(set(known)))
    return phi


@pytest.mark.parametrize("kind", ["boosted class", "boosted number", "forest class", "forest number", "one against rest"])
def test_values_by_definition_and_additivity(spark, rows, kind):
    binary = rows.withColumn("label", F.least("label", F.lit(1.0)))
    model, table = {
        "boosted class": lambda: (GBTClassifier(maxIter=4, maxDepth=4, seed=1).fit(binary), binary),
        "boosted number": lambda: (GBTRegressor(maxIter=4, maxDepth=4, seed=1).fit(rows), rows),
        "forest class": lambda: (RandomForestClassifier(numTrees=4, maxDepth=6, seed=1).fit(rows), rows),
        "forest number": lambda: (RandomForestRegressor(numTrees=4, maxDepth=6, seed=1).fit(rows), rows),
        "one against rest": lambda: (OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=1)).fit(rows), rows),
    }[kind]()
    leaves = A.flatten(spark, model)
    found = {}
    for r in A.tree_contributions(table, "id", model).collect():
        found.setdefault(r["id"], []).append(r)
    scored = model.transform(table)
    column = {"boosted class": "rawPrediction", "forest class": "probability", "one against rest": "rawPrediction"}.get(kind)
    for r in scored.orderBy("id").limit(40).collect():
        parts = sorted(found[r["id"]], key=lambda p: p["output"])
        total = np.array([p["expected"] + sum(p["contributions"]) for p in parts])
        output = np.array([r["prediction"]]) if column is None else r[column].toArray()
        assert np.allclose(total, output[1:] if kind == "boosted class" else output)
        if r["id"] < 4:
            assert np.allclose([p["contributions"] for p in parts], plain_values(leaves, np.array(r["x"])))
    assert len(found) == table.count()


def test_nominal_features_and_missing_numbers(spark, rows):
    """Splits on categories, and a value that is not a number, which goes right as in the model."""
    from pyspark.ml.feature import OneHotEncoder

    coded = OneHotEncoder(inputCol="k", outputCol="o", dropLast=False).fit(rows.withColumn("k", F.col("x")[1])).transform(rows.withColumn("k", F.col("x")[1]))
    table = VectorAssembler(inputCols=["o", "a"], outputCol="f").transform(coded.withColumn("a", F.col("x")[0]))
    model = GBTRegressor(featuresCol="f", maxIter=3, maxDepth=3, seed=1).fit(table)
    assert any(c.values is not None for leaf in A.flatten(spark, model) for c in leaf.conditions)
    odd = table.withColumn("a", F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("a"))).drop("f")
    odd = VectorAssembler(inputCols=["o", "a"], outputCol="f", handleInvalid="keep").transform(odd)
    total = F.col("expected") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    both = A.tree_contributions(odd, "id", model, "f").select("id", total.alias("t")).join(model.transform(odd), "id")
    assert both.where(F.abs(F.col("t") - F.col("prediction")) > 1e-9).count() == 0


def test_mean_attribution(spark, rows):
    binary = rows.withColumn("label", F.least("label", F.lit(1.0)))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(binary)
    found = {r["feature"]: r["mean_abs"] for r in feature_attribution(binary, "id", model, list("abcd"), "classification").collect()}
    each = np.array([r["contributions"] for r in A.tree_contributions(binary, "id", model).collect()])
    assert np.allclose([found[c] for c in "abcd"], np.abs(each).mean(axis=0))
    linear = linear_regressor().fit(rows)
    exact = {r["feature"]: r["mean_abs"] for r in linear_attribution(rows, linear.coefficients.toArray(), list("abcd")).collect()}
    x = np.array([r["x"] for r in rows.select(vector_to_array("features").alias("x")).collect()])
    assert np.allclose([exact[c] for c in "abcd"], np.abs((x - x.mean(axis=0)) * linear.coefficients.toArray()).mean(axis=0))
    with pytest.raises(ValueError):
        A.tree_attribution(rows, "id", linear, list("abcd"))


def test_training_rows_use_all_cores(spark):
    """One file is one partition, and a model would pass over it with one core."""
    df = spark.range(0, 25_000, 1, 1).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 2).cast("double").alias("label"), "id")
    rows = M.training_rows(df)
    assert rows.rdd.getNumPartitions() >= 3 and rows.columns == ["features", "label"]
    assert rows.count() == 25_000 and rows.agg(F.sum("label")).first()[0] == 12_500
    assert M.training_rows(df.limit(40)).rdd.getNumPartitions() == 1
    assert M.forest("classification").getCacheNodeIds() and M.forest("regression").getNumTrees() == 100


def test_attributed_rows_use_all_cores(spark, tmp_path):
    """The values of a row are dear, and a file of one row group would give all of them to one task."""
    df = spark.range(0, 25_000, 1, 1).select(array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"), (F.col("id") % 7 % 2).cast("double").alias("label"), "id")
    df.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    model = M.gradient_boosting("classification", rounds=2, max_depth=2).fit(one.limit(200))
    found = A.tree_contributions(one, "id", model)
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 25_000 and max(parts) <= 12_500
    assert found.select("id").distinct().count() == 25_000

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataquarry.functions import tails
from dataquarry.operators import metrics as M
from dataquarry.operators import sampling as A
from dataquarry.operators import stats as S
from dataquarry.operators.supervised import select_model


def test_tails_known_values():
    assert abs(tails.f_sf(4.0, 3, 20) - 0.0220769996) < 1e-9
    assert abs(tails.chi2_sf(5.0, 3) - 0.1717971443) < 1e-9
    assert abs(tails.t_sf_two_sided(2.0, 4) - 0.1161165235) < 1e-9
    assert abs(tails.t_sf_two_sided(-2.0, 4) - 0.1161165235) < 1e-9
    assert 0 < tails.chi2_sf(900.0, 2) < 1e-190


def test_tails_agree_with_commons_math(spark):
    math3 = spark._jvm.org.apache.commons.math3.distribution
    for f, a, b in [(0.3, 1, 9), (1.54247, 2, 59997), (2.5, 7, 40)]:
        assert abs(tails.f_sf(f, a, b) - (1 - math3.FDistribution(float(a), float(b)).cumulativeProbability(f))) < 1e-8
    for x, d in [(0.5, 1), (12.0, 9), (40.0, 30)]:
        assert abs(tails.chi2_sf(x, d) - (1 - math3.ChiSquaredDistribution(float(d)).cumulativeProbability(x))) < 1e-8


def _one(df):
    return df.first().asDict()


def test_anova_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), ("c", None)], "g string, x double")
    assert _one(S.anova_by_class(df, "g"))["stat"] is None  # an empty group
    got = _one(S.anova_by_class(df.filter("g <> 'c'"), "g"))
    assert np.isclose(got["stat"], 5.0) and (got["dof1"], got["dof2"]) == (1, 2)
    assert _one(S.anova_by_class(df.filter("g = 'a'"), "g"))["stat"] is None  # one class
    constant = df.filter("g <> 'c'").withColumn("x", F.lit(1.0))
    assert _one(S.with_p_values(S.anova_by_class(constant, "g")))["p"] == 1.0


def test_chi2_with_yates_and_empty_cells(spark):
    two = spark.createDataFrame([("a", 0)] * 10 + [("a", 1)] * 2 + [("b", 0)] * 3 + [("b", 1)] * 9, "x string, y int")
    o = np.array([[10, 2], [3, 9]])
    e = o.sum(1)[:, None] * o.sum(0)[None] / o.sum()
    assert np.isclose(_one(S.chi2_independence(two, "y"))["stat"], ((abs(o - e) - 0.5) ** 2 / e).sum())
    three = spark.createDataFrame([("a", 0)] * 10 + [("b", 1)] * 5 + [("c", 0)] * 3 + [("c", 1)] * 2, "x string, y int")
    o = np.array([[10, 0], [0, 5], [3, 2]])
    e = o.sum(1)[:, None] * o.sum(0)[None] / o.sum()
    assert np.isclose(_one(S.chi2_independence(three, "y"))["stat"], ((o - e) ** 2 / e).sum())
    single = spark.createDataFrame([("a", 0), ("a", 1)], "x string, y int")
    assert _one(S.with_p_values(S.chi2_independence(single, "y")))["p"] == 1.0


def test_pearson_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "x double, y double, k double")
    got = {r["feature"]: r for r in S.pearson_target(df, "y").collect()}
    assert np.isclose(got["x"]["r"], np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert got["k"]["r"] is None and got["k"]["stat"] is None


def test_selection_approves_real_effects(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"noise": rng.normal(size=400), "signal": y + rng.normal(size=400), "cat": np.where(y == 1, "p", "q"), "y": y})
    got = {r["feature"]: r["approved"] for r in S.select_by_pvalue(spark.createDataFrame(pdf), "y", "classification").collect()}
    assert got["signal"] and got["cat"]
    with pytest.raises(ValueError):
        S.hypothesis_tests(spark.createDataFrame(pdf), "y", "ranking")


def test_vif_prune_orders(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": 2 * a, "c": rng.normal(size=300), "k": 1.0})
    df = spark.createDataFrame(pdf)
    by_p = {r["feature"]: r for r in S.vif_prune(df, ["a", "b", "c"], {"a": 0.01, "b": 0.02, "c": 0.04}).collect()}
    assert by_p["c"]["removed_at"] == 1 and by_p["b"]["removed_at"] == 2 and by_p["a"]["removed_at"] is None
    by_vif = {r["feature"]: r for r in S.vif_prune(df, ["a", "b", "c"], {"a": 0.01, "b": 0.02, "c": 0.04}, order="vif").collect()}
    assert by_vif["b"]["removed_at"] == 1 and by_vif["c"]["removed_at"] is None
    assert {r["feature"]: r["vif"] for r in S.vif_scores(df, ["a", "k"]).collect()}["k"] is None


def test_correlation_paths_agree(spark):
    pdf = pd.DataFrame(np.random.default_rng(2).normal(size=(100, 18)), columns=[f"c{i}" for i in range(18)])
    want = pdf.corr().to_numpy()
    assert np.allclose(S.correlation_array(spark.createDataFrame(pdf), list(pdf.columns)), want)
    assert np.allclose(S.correlation_array(spark.createDataFrame(pdf), ["c0", "c1", "c2"]), want[:3, :3])


def test_identical_scores_choose_linear(spark):
    rows = [(m, f, 0.5) for m in ("linear", "gradient_boosting") for f in range(5)]
    assert select_model(spark.createDataFrame(rows, "model string, fold int, score double")).first()["winner"] == "linear"
    rows = [("linear", f, 0.5) for f in range(5)] + [("gradient_boosting", f, 0.2 + 0.01 * f) for f in range(5)]
    worse = spark.createDataFrame(rows, "model string, fold int, score double")
    assert select_model(worse).first()["winner"] == "gradient_boosting"  # two-sided by default
    assert select_model(worse, one_sided=True).first()["winner"] == "linear"


def test_split_is_exact_per_class_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") == 7, "solo").when(F.col("id") % 3 == 0, "hot").otherwise("rest").alias("y"))
    out = A.train_test_split(df, "id", "y")
    sizes = {r["y"]: (r["n"], r["t"]) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == int(np.floor(0.2 * n + 0.5)) for n, t in sizes.values()) and sizes["solo"] == (1, 0)
    again = A.train_test_split(df.repartition(7), "id", "y")
    assert out.join(again.withColumnRenamed("is_test", "b"), "id").filter("is_test <> b").count() == 0
    folds = A.kfold_assign(df, "id", "y").groupBy("y", "fold").count().collect()
    for y, (n, _) in sizes.items():
        counts = [r["count"] for r in folds if r["y"] == y]
        assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_auc_with_ties(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 20, 500) / 20
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / len(pos) / len(neg)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert np.isclose(M.roc_auc(df, "y", "s").first()["auc"], want)
    assert M.roc_auc(df.filter("y = 1"), "y", "s").first()["auc"] is None


def test_metrics_with_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "y string, p string")
    r = M.classification_metrics(df, "y", "p").first()
    assert np.isclose(r["accuracy"], 0.5) and np.isclose(r["precision"], (2 * 1 + 1 * 0.5 + 0) / 4)
    assert np.isclose(r["recall"], 0.5) and np.isclose(r["f1"], (2 * 2 / 3 + 2 / 3) / 4)


def test_group_sample_is_cut_before_the_shuffle(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 2).alias("g"))
    out = A.sample_per_group(df, ["g"], "id", 3)
    assert out.groupBy("g").count().filter("count = 3").count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_inflation_of_a_thousand_columns():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 1000))
    x[:, 900:] += x[:, :100]  # a hundred inflated pairs
    matrix = np.corrcoef(x, rowvar=False)
    inflation = S._Inflation(matrix)
    for out in (3, 950, 17):
        inflation.values()
        inflation.remove(out)
    left = inflation.left
    assert np.allclose(inflation.values(), np.diag(np.linalg.inv(matrix[np.ix_(left, left)])))
    twin = np.corrcoef(np.c_[x[:, :3], x[:, 0] * 2 + 1, x[:, 1] + x[:, 2]], rowvar=False)
    inflation = S._Inflation(twin)
    assert np.isinf(inflation.values()).all()
    inflation.remove(3)
    assert inflation.values()[0] < 1.1 and np.isinf(inflation.values()[1:]).all()
    inflation.remove(4)
    assert (inflation.values() < 1.1).all()

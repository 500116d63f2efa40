import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataquarry.operators import clean as C
from dataquarry.operators import features as X
from dataquarry.operators import ordered as O
from dataquarry.operators import profile as P
from dataquarry.operators import route as R


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.gamma(2, 3, 500), "i": rng.integers(0, 9, 500), "c": rng.choice(list("abc"), 500)})
    pdf.loc[::7, "x"] = np.nan
    got = {r["column"]: r for r in P.profile_table(spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))).collect()}
    for c in ("x", "i"):
        s = pdf[c].dropna()
        r = got[c]
        assert r["tipo"] == "Numérico" and r["mode"] is None and r["cardinality"] == s.nunique()
        assert np.allclose([r["mean"], r["std"], r["skewness"], r["kurtosis"]], [s.mean(), s.std(), s.skew(), s.kurtosis()])
    assert got["x"]["nulls"] == 72 and got["x"]["pct_nulls"] == 14.4
    assert got["c"]["mode"] == pdf["c"].mode()[0] and got["c"]["mode_count"] == pdf["c"].value_counts().max()


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    r = P.profile_categorical(df).first()
    assert (r["cardinality"], r["mode"], r["mode_count"]) == (3, "a", 2)


def test_profile_of_long_text_and_redaction(spark):
    texts = ["x" * 60] * 3 + ["a" * 70] * 3 + ["z" * 80]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = P.profile_table(df).first()
    assert (r["tipo"], r["cardinality"], r["mode"], r["mode_count"]) == ("Texto Libre", 2 + 1, "a" * 70, 3)
    assert P.profile_table(df, redact_values=True).first()["mode"] is None
    unique = spark.createDataFrame([("q" * 60,), ("b" * 60,)], "t string")
    assert P.profile_table(unique).first()["mode"] == "b" * 60


def test_profile_of_empty_and_all_null(spark):
    df = spark.createDataFrame([], "a int, s string")
    got = {r["column"]: r for r in P.profile_table(df).collect()}
    assert got["a"]["total"] == 0 and got["a"]["pct_nulls"] == 0.0 and got["s"]["tipo"] == "Categórico"
    nulls = spark.createDataFrame([(None, None), (None, None)], "a double, s string")
    got = {r["column"]: r for r in P.profile_table(nulls).collect()}
    assert got["a"]["cardinality"] == 0 and got["a"]["mean"] is None and got["s"]["mode"] is None


def test_null_text_counts_as_three_characters(spark):
    df = spark.createDataFrame([("x" * 90,), (None,)], "s string")  # mean 46.5 with the null, 90 without
    assert P.semantic_types(df) == {"s": "Categórico"}
    assert P.semantic_types(df, null_length=None) == {"s": "Texto Libre"}


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "x": rng.normal(size=n).round(2), "y": rng.integers(0, 4, n).astype(float)})
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = O.exact_quantiles(spark.createDataFrame(pdf), ["x", "y"], probs, ["g"]).collect()
    assert len(got) == 2 * pdf["g"].nunique()
    for r in got:
        s = pdf.loc[pdf["g"] == r["g"], r["feature"]]
        assert r["n"] == len(s) and np.allclose(r["q"], np.quantile(s, probs))


def test_quantiles_with_a_hot_value(spark):
    # A third of the rows are equal.
    values = np.concatenate([np.full(4000, 7.0), np.random.default_rng(3).normal(5, 3, 8000)])
    got = O.exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": values})), ["x"], [0.25, 0.5, 0.6]).first()
    assert np.allclose(got["q"], np.quantile(values, [0.25, 0.5, 0.6]))


def test_quantiles_of_extremes(spark):
    inf, nan = float("inf"), float("nan")
    columns = {
        "inf": [-inf, -inf, -1e300, -5e-324, 0.0, 5e-324, 1.0, 1e300, inf], "nan": [1.0, 2.0, nan, nan, None, None, None, None, None],
        "one": [3.5] + [None] * 8, "none": [None] * 9, "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, -1.0, -1.0 - 2**-52, 1.0, 1.0, -0.0, 0.0],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["feature"]: (r["n"], r["q"]) for r in O.exact_quantiles(df, list(columns), probs).collect()}
    assert set(got) == {"inf", "nan", "one", "close"}
    assert got["inf"] == (9, [-inf, -1e300, 0.0, 1.0, inf]) and got["one"] == (1, [3.5] * 5)
    assert got["nan"][0] == 4 and got["nan"][1][:2] == [1.0, 1.75] and np.isnan(got["nan"][1][3:]).all()
    assert got["close"][1] == list(np.quantile(columns["close"], probs))


def test_quantiles_of_many_skewed_rows(spark):
    values = np.exp(np.random.default_rng(8).normal(0, 12, 300_000))
    values[:50_000] = 0.0
    probs = [0.01, 0.2, 0.5, 0.9, 0.999]
    got = O.exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": values})), ["x"], probs).first()
    assert got["n"] == 300_000 and np.allclose(got["q"], np.quantile(values, probs), rtol=1e-12)


def test_running_totals(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("s"), (F.col("id") % 5).alias("w"))
    pdf = df.toPandas().sort_values("s")
    want = dict(zip(pdf["s"], pdf["w"].cumsum() - pdf["w"]))
    got = {r["s"]: r["before"] for r in O.running_totals(df, ["s"], {"before": "w"}).collect()}
    assert got == want


def test_missing_threshold_is_strict(spark):
    df = spark.createDataFrame([(None, None, 1)] * 6 + [(1, None, 1)] * 4, "sixty int, all int, full int")
    assert C.drop_high_missing(df).columns == ["sixty", "full"]
    assert C.drop_high_missing(df.limit(0)).columns == df.columns


def test_imputation(spark):
    df = spark.createDataFrame([(1, "b", None, None), (2, "a", None, 1.0), (None, None, None, 3.0), (4, "a", None, None)], "i int, s string, n string, x double")
    out = C.impute_missing(df).collect()
    assert [r["i"] for r in out] == [1, 2, 2, 4] and [r["s"] for r in out] == ["b", "a", "a", "a"]
    assert {r["n"] for r in out} == {"MISSING"} and [r["x"] for r in out] == [2.0, 1.0, 3.0, 2.0]
    half = C.impute_missing(spark.createDataFrame([(1,), (2,), (None,)], "i int"))
    assert [r["i"] for r in half.collect()] == [1.0, 2.0, 1.5]


def test_cleaning_plan_ignores_unknown(spark, caplog):
    df = spark.createDataFrame([(1.0, None, "x"), (None, "q", "y")], "a double, b string, c string")
    out = C.apply_cleaning_plan(df, [("a", "impute_median"), ("b", "IMPUTE_MODE"), ("c", "drop"), ("zz", "drop"), ("a", "shine"), ("b", "keep")])
    assert [tuple(r) for r in out.collect()] == [(1.0, "q"), (1.0, "q")]
    assert "zz" in caplog.text and "shine" in caplog.text


def test_routes(spark):
    long = "w" * 60
    df = spark.createDataFrame([(1, long, "a", long)], "n int, t string, c string, u string")
    assert R.route_decision(df).first()["route"] == "fase_2"  # exactly half is not a majority
    assert R.route_decision(df.drop("c")).first()["route"] == "fase_3"
    assert R.route_decision(df, "c").first()["route"] == "fase_1"
    assert R.route_decision(df, "t").first()["route"] == "fase_3"
    assert R.route_decision(df, assume_last=True).first()["target"] == "u"
    with pytest.raises(ValueError):
        R.route_decision(df, "nope")


@pytest.mark.parametrize("n,task", [(14, "classification"), (15, "regression")])
def test_task_by_cardinality(spark, n, task):
    assert R.infer_task_type(spark.range(n).toDF("y"), "y").first()["task"] == task


def test_zero_width_scaling(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 6 + [50]], "x double")
    assert [r["x"] for r in X.robust_scale(df, ["x"]).collect()] == [0.0] * 6 + [49.0]


def test_one_hot_unknown_is_zero(spark):
    from pyspark.ml.functions import vector_to_array

    model = X.one_hot(spark.createDataFrame([("b",), ("a",), ("c",)], "v string"), ["v"])
    test = spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "v string")
    got = [r["h"] for r in model.transform(test).select(vector_to_array("v__hot").alias("h")).collect()]
    assert got == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]
    with pytest.raises(ValueError):
        X.one_hot(test, ["v"], max_categories=1)


def test_preprocessor_quotes_values(spark):
    df = spark.createDataFrame([("it's \\ a", 1.0), ("it's \\ a", 2.0), (None, None)], "c string, x double")
    model, names = X.build_preprocessor(df, ["x"], ["c"])
    assert names == ["num__x", "cat__c_it's \\ a"]
    assert [list(r["features"]) for r in X.transform_features(model, df).collect()] == [[-1.0, 1.0], [1.0, 1.0], [0.0, 1.0]]


def test_label_encode_is_numeric_for_numbers(spark):
    out = X.label_encode(spark.createDataFrame([(10,), (9,), (100,), (9,), (None,)], "y int"), "y")
    assert sorted({(r["y"], r["label"]) for r in out.collect()}, key=str) == sorted({(9, 0), (10, 1), (100, 2), (None, None)}, key=str)


def test_modes_of_long_texts_without_shuffling_them(spark):
    """Ties, values that share long beginnings, and values at the border of a head are told apart."""
    from collections import Counter

    for n in (63, 64, 65, 1024, 1025, 20000):
        base = "é" * n
        values = [base + "b", base + "a", base + "a", base + "b", base, "zz", "zz", None, base + "aa", ""]
        df = spark.createDataFrame([(v, v if i % 2 else None, i) for i, v in enumerate(values)], "t string, u string, i int")
        got = {r["column"]: r for r in P.profile_categorical(df).collect()}
        for c, kept in (("t", [v for v in values if v is not None]), ("u", [v for i, v in enumerate(values) if i % 2 and v is not None])):
            counts = Counter(kept)
            most = max(counts.values())
            assert (got[c]["cardinality"], got[c]["mode"], got[c]["mode_count"]) == (len(counts), min(v for v in counts if counts[v] == most), most)
    assert P.profile_categorical(df.limit(0)).count() == 0


def test_statistics_of_long_texts_are_those_of_short_ones(spark):
    from dataquarry.operators import stats as S

    rows = [(i % 3, "cab"[i % 3] if i % 7 else "d", float(i * i % 11)) for i in range(60)]
    short = spark.createDataFrame(rows, "k int, c string, y double").withColumn("b", F.concat(F.lit("k"), "k"))
    long = short.withColumn("c", F.concat(F.lit("x" * 500), "c")).withColumn("b", F.concat(F.lit("y" * 500), "b"))
    for test, target in ((S.chi2_independence, "b"), (S.anova_by_category, "y"), (S.anova_by_class, "b")):
        got = [sorted((r["feature"], r["test"], round(r["stat"], 9), r["dof1"], r["dof2"]) for r in test(t, target).collect() if r["stat"] is not None) for t in (short, long)]
        assert got[0] == got[1] and got[0]

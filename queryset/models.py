"""Feature building, candidate models, cross-validation, evaluation, attribution."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from dataquarry.operators import attribution as A
from dataquarry.operators import features as X
from dataquarry.operators import supervised as M
from dataquarry.operators.sampling import kfold_assign, train_test_split
from queryset.common import ORDERS_SQL, Registry, orders_cls, rnd, sql_hash, table

REGISTRY = Registry()

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@REGISTRY.add("build_preprocessor", """
with q as (select quantile_cont(c_acctbal, 0.25) as a1, quantile_cont(c_acctbal, 0.5) as a2, quantile_cont(c_acctbal, 0.75) as a3 from customer)
select c_custkey, round((c_acctbal - a2) / (a3 - a1), 4) as num__c_acctbal, """ + ", ".join(
    f"cast(c_mktsegment = '{s}' as double) as cat__c_mktsegment_{s}" for s in _SEGMENTS) + " from customer, q")
def build_preprocessor(spark, sf):
    df = table(spark, sf, "customer")
    model, names = X.build_preprocessor(df, ["c_acctbal"], ["c_mktsegment"])
    v = vector_to_array(F.col("features"))
    return X.transform_features(model, df).select("c_custkey", *[rnd(v[i]).alias(n) for i, n in enumerate(names)])


def _training(spark, sf, key="o_orderkey"):
    """Preprocessed orders with label, and the feature names."""
    df = orders_cls(spark, sf).withColumn("label", F.col("y").cast("double"))
    df = train_test_split(df, key, "y")
    train = df.filter("not is_test")
    prep, names = X.build_preprocessor(train, ["o_custkey", "f", "score"], ["o_orderstatus", "o_orderpriority"])
    return X.transform_features(prep, train), X.transform_features(prep, df.filter("is_test")), names


def _counts(pred):
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("fit_linear_classifier")
def fit_linear_classifier(spark, sf):
    train, test, _ = _training(spark, sf)
    return _counts(M.linear_classifier(train.count()).fit(train).transform(test))


@REGISTRY.add("fit_linear_regressor", f"""with {ORDERS_SQL},
 m as (select regr_slope(o_totalprice, f) as b, regr_intercept(o_totalprice, f) as a from ord)
select o_orderkey, round(a + b * f, 2) as prediction from ord, m""")
def fit_linear_regressor(spark, sf):
    df = orders_cls(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("label"), array_to_vector(F.array("f")).alias("features"))
    return M.linear_regressor().fit(df).transform(df).select("o_orderkey", rnd("prediction", 2).alias("prediction"))


@REGISTRY.add("fit_forest")
def fit_forest(spark, sf):
    train, test, _ = _training(spark, sf)
    return _counts(M.forest("classification").fit(M.training_rows(train)).transform(M.training_rows(test)))


@REGISTRY.add("fit_gradient_boosting")
def fit_gradient_boosting(spark, sf):
    train, test, _ = _training(spark, sf)
    return _counts(M.gradient_boosting("classification").fit(M.training_rows(train)).transform(M.training_rows(test)))


@REGISTRY.add("cross_validate")
def cross_validate(spark, sf):
    df = orders_cls(spark, sf).withColumn("label", F.col("y").cast("double"))
    df = kfold_assign(df, "o_orderkey", "y")
    return M.cross_validate(df, ["o_custkey", "f"], ["o_orderstatus"], "classification")


_FOLDS = f"""d as (select p_retailprice as y, cast(p_size as double) as x, {sql_hash('p_partkey', 'fold')} % 5 as fold from part),
 k as (select unnest(range(5)) as fold),
 fit as (select k.fold, quantile_cont(y, 0.5) as middle, regr_slope(y, x) as b, regr_intercept(y, x) as a from k join d on d.fold <> k.fold group by 1)"""


@REGISTRY.add("cross_validate_linear", f"""with {_FOLDS}
select 'baseline' as model, cast(fold as integer) as fold, round(-sqrt(avg((y - middle) ** 2)), 4) as score from d join fit using (fold) group by 2
union all select 'linear', cast(fold as integer), round(-sqrt(avg((y - a - b * x) ** 2)), 4) from d join fit using (fold) group by 2""")
def cross_validate_linear(spark, sf):
    """The median and a line through one feature, fold by fold."""
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("p_size"))
    folded = kfold_assign(df, "p_partkey")
    return M.cross_validate(folded, ["p_size"], [], "regression", models=("baseline", "linear")).withColumn("score", rnd("score"))


@REGISTRY.add("evaluate_scored", f"""with {ORDERS_SQL}, k as (select distinct y as c from ord),
 s as (select c, (select count(*) from ord where y = c) as n, (select count(*) from ord where pred = c) as m,
   (select count(*) from ord where y = c and pred = c) as tp from k),
 r as (select score, sum(y) as p, sum(1 - y) as q from ord group by 1),
 b as (select p, q, sum(q) over (order by score) - q as below from r)
select 'accuracy' as metric, round(sum(tp) / sum(n), 4) as value from s
union all select 'precision', round(sum(n * case when m > 0 then tp / m else 0 end) / sum(n), 4) from s
union all select 'recall', round(sum(n * (tp / n)) / sum(n), 4) from s
union all select 'f1', round(sum(n * (2 * tp / (n + m))) / sum(n), 4) from s
union all select 'roc_auc', round(sum(p * (below + q / 2)) / sum(p) / sum(q), 4) from b""")
def evaluate_scored(spark, sf):
    """The metrics of predictions and probabilities made by a rule."""
    df = orders_cls(spark, sf).select(
        F.col("y").cast("double").alias("label"), F.col("pred").cast("double").alias("prediction"),
        array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("probability"),
    )
    return M.evaluate(df, "classification").withColumn("value", rnd("value"))


@REGISTRY.add("evaluate")
def evaluate(spark, sf):
    train, test, _ = _training(spark, sf)
    return M.evaluate(M.linear_classifier(train.count()).fit(train).transform(test), "classification")


@REGISTRY.add("feature_attribution", """
select 'acctbal' as feature, round(2.0 * avg(abs(c_acctbal - m)), 4) as mean_abs from customer, (select avg(c_acctbal) as m from customer)
union all select 'nation', round(1.5 * avg(abs(c_nationkey - m)), 4) from customer, (select avg(c_nationkey) as m from customer)""")
def feature_attribution(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", array_to_vector(F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))).alias("features"))
    return M.linear_attribution(df, [2.0, -1.5], ["acctbal", "nation"]).withColumn("mean_abs", rnd("mean_abs"))


@REGISTRY.add("feature_attribution_trees")
def feature_attribution_trees(spark, sf):
    """Mean absolute Shapley values of a boosted model."""
    train, test, names = _training(spark, sf)
    model = M.gradient_boosting("classification").fit(M.training_rows(train))
    return M.feature_attribution(test, "o_orderkey", model, names, "classification").withColumn("mean_abs", rnd("mean_abs", 6))


@REGISTRY.add("tree_contributions", f"""with {ORDERS_SQL}, r as (
  select o_orderkey, row_number() over (partition by y order by {sql_hash('o_orderkey', 'split')}, o_orderkey) as rn, count(*) over (partition by y) as n from ord)
select o_orderkey, 0.0 as gap from r where rn <= floor(0.2 * n + 0.5)""")
def tree_contributions(spark, sf):
    """Of every test row: what the margin of a boosted model differs from its mean plus the row's contributions."""
    train, test, _ = _training(spark, sf)
    model = M.gradient_boosting("classification", rounds=20).fit(M.training_rows(train))
    scored = model.transform(test).select("o_orderkey", "features", vector_to_array("rawPrediction")[1].alias("margin"))
    found = A.tree_contributions(scored, "o_orderkey", model)
    total = F.col("expected") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    joined = found.select("o_orderkey", total.alias("t")).join(scored.select("o_orderkey", "margin"), "o_orderkey")
    return joined.select("o_orderkey", F.abs(rnd(F.col("t") - F.col("margin"), 6)).alias("gap"))

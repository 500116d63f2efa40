"""Candidate models, cross-validation, parsimonious selection, evaluation, attribution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.attribution import tree_attribution
from dataquarry.operators.columns import col
from dataquarry.operators.features import build_preprocessor, transform_features
from dataquarry.operators.metrics import (
    baseline_predictor,
    classification_metrics,
    regression_metrics,
    roc_auc,
    roc_auc_weighted,
)
from dataquarry.operators.stats import P_VALUE_LIMIT, paired_ttest, with_p_values
from dataquarry.operators.trees import MANY_ROWS, BinnedBoosting, BinnedForest
from dataquarry.runtime import balance, concurrently, discard, materialise

SEED = 42
MODELS = ("baseline", "linear", "forest", "gradient_boosting")


def linear_classifier(n_train: int, c: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """L2 logistic regression: the summed loss times C equals the mean loss over ``1 / (C n)``."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=max_iter,
        regParam=1.0 / (c * n_train), elasticNetParam=0.0, standardization=False,
    )


def linear_regressor() -> LinearRegression:
    """Ordinary least squares."""
    return LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, solver="auto")


def forest(task: str, trees: int = 100, max_depth: int = 30):
    """Random forest: square root of the features per split to classify, all of them to regress.

    Trees grow to 30 levels, the most that MLlib allows; ``max_depth`` bounds them.  Every
    row's node is remembered, so that no level walks all trees from their roots again.
    """
    kind = BinnedForest if task == "classification" else RandomForestRegressor
    return kind(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=max_depth, seed=SEED,
        featureSubsetStrategy="sqrt" if task == "classification" else "all", cacheNodeIds=True,
    )


def gradient_boosting(task: str, classes: int = 2, rounds: int = 100, max_depth: int = 5):
    """Histogram gradient boosting; one-vs-rest for more than two classes."""
    options = {
        "featuresCol": "features", "labelCol": "label", "maxIter": rounds, "stepSize": 0.1,
        "maxDepth": max_depth, "maxBins": 256, "seed": SEED,
    }
    if task != "classification":
        return GBTRegressor(**options)
    one = BinnedBoosting(**options)
    return one if classes <= 2 else OneVsRest(classifier=one, featuresCol="features", labelCol="label")


def make_model(name: str, task: str, n_train: int, classes: int, rounds: int = 100, trees: int = 100):
    if name == "linear":
        return linear_classifier(n_train) if task == "classification" else linear_regressor()
    if name == "forest":
        return forest(task, trees)
    return gradient_boosting(task, classes, rounds)


def score_predictions(pred: DataFrame, task: str) -> float:
    """Weighted F1, or the negative RMSE."""
    if task == "classification":
        return float(classification_metrics(pred, "label", "prediction").first()["f1"])
    return -float(regression_metrics(pred, "label", "prediction").first()["rmse"])


def training_rows(df: DataFrame) -> DataFrame:
    """``features`` and ``label`` of the rows, written and spread over all cores.

    A model passes over its rows hundreds of times.  A table read from one file may be one
    partition, and every pass would keep one core busy.
    """
    written = materialise(df.select("features", "label"), "training")
    rows = balance(written, "training")
    if rows is not written:
        discard(written)
    return rows


def cross_validate(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    task: str,
    folds: int = 5,
    models: Sequence[str] = MODELS,
    rounds: int = 100,
    trees: int = 100,
    parallelism: int = 4,
) -> DataFrame:
    """``(model, fold, score)``; needs columns ``label`` and ``fold``.

    Preprocessing is fitted inside every fold.  Folds run as concurrent Spark jobs.  A large table is
    written once for all folds, and their features are made from it on the way: the classifiers pass
    over them a few times only, and features of every fold would fill the disk.
    """
    classes = train.select("label").distinct().count() if task == "classification" else 0
    large = task == "classification" and train.count() >= MANY_ROWS
    if large:
        written = materialise(train.select("label", "fold", *[col(c) for c in (*numeric, *categorical)]), "folded")
        train = balance(written, "folded")
        if train is not written:
            discard(written)

    def run_fold(i: int) -> list[tuple[str, int, float]]:
        inside = train.filter((F.col("fold") != i) & F.col("label").isNotNull())
        outside = train.filter((F.col("fold") == i) & F.col("label").isNotNull())
        prep, _ = build_preprocessor(inside, numeric, categorical)
        fit, held = transform_features(prep, inside), transform_features(prep, outside)
        if not large:
            fit = training_rows(fit).persist(StorageLevel.MEMORY_AND_DISK)
            held = training_rows(held).persist(StorageLevel.MEMORY_AND_DISK)
        n = fit.count()
        out = []
        for name in models:
            if name == "baseline":
                pred = baseline_predictor(fit.select("label"), held, "label", task)
            else:
                pred = make_model(name, task, n, classes, rounds, trees).fit(fit).transform(held)
            out.append((name, i, score_predictions(pred, task)))
        if not large:
            fit.unpersist()
            held.unpersist()
        return out

    done = concurrently(train.sparkSession, run_fold, range(folds), parallelism)
    if large:
        discard(train)
    rows = [r for part in done for r in part]
    return train.sparkSession.createDataFrame(rows, "model string, fold int, score double")


def select_model(scores: DataFrame, threshold: float = P_VALUE_LIMIT, one_sided: bool = False) -> DataFrame:
    """``(stat, p, winner)``: the complex model must differ significantly, else the linear one wins."""
    tested = with_p_values(paired_ttest(scores, "gradient_boosting", "linear"))
    differs = F.col("p") <= threshold
    if one_sided:
        differs = differs & (F.col("stat") > 0)
    return tested.select("stat", "p", F.when(differs, "gradient_boosting").otherwise("linear").alias("winner"))


def evaluate(pred: DataFrame, task: str) -> DataFrame:
    """``(metric, value)`` on scored rows with ``label`` and ``prediction``."""
    if task == "classification":
        scores = next((c for c in ("probability", "rawPrediction") if c in pred.columns), None)
        # Written once: every metric would score the rows again.
        pred = materialise(pred.select("label", "prediction", *([scores] if scores else [])), "scored")
        row = classification_metrics(pred, "label", "prediction").first().asDict()
        classes = [r[0] for r in pred.select("label").distinct().orderBy("label").collect()]
        if scores is not None and len(classes) > 1:
            scored = pred.select("label", vector_to_array(F.col(scores)).alias("s"))
            if len(classes) == 2:
                row["roc_auc"] = roc_auc(scored.select("label", F.col("s")[1].alias("p")), "label", "p", classes[1]).first()["auc"]
            else:
                # Scores are ordered by label code, which may include classes absent here.
                parts = scored.select("label", F.array(*[F.col("s")[int(c)] for c in classes]).alias("s"))
                row["roc_auc"] = roc_auc_weighted(parts, "label", "s", classes).first()["auc"]
    else:
        row = regression_metrics(pred, "label", "prediction").first().asDict()
    rows = [(k, None if v is None else float(v)) for k, v in row.items()]
    return pred.sparkSession.createDataFrame(rows, "metric string, value double")


def linear_attribution(df: DataFrame, coefficients: Sequence[float], names: Sequence[str], features: str = "features") -> DataFrame:
    """``(feature, mean_abs)``: exact mean ``|coef * (x - mean)|`` of a linear model, two vector passes."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_c").fit(df).transform(df)
    row = centred.select(Summarizer.metrics("normL1", "count").summary(F.col("_c")).alias("s")).select("s.normL1", "s.count").first()
    spread = np.asarray(row["normL1"].toArray()) / max(row["count"], 1)
    values = np.abs(np.asarray(coefficients)) * spread
    return df.sparkSession.createDataFrame(list(zip(names, map(float, values))), "feature string, mean_abs double")


def feature_attribution(scored: DataFrame, key: str, model, names: Sequence[str], task: str) -> DataFrame:
    """``(feature, mean_abs)``: exact values of linear models and tree ensembles, over all rows."""
    if hasattr(model, "coefficientMatrix") and task == "classification":
        matrix = model.coefficientMatrix.toArray()
        return linear_attribution(scored, np.abs(matrix).sum(axis=0), names)
    if hasattr(model, "coefficients"):
        return linear_attribution(scored, model.coefficients.toArray(), names)
    return tree_attribution(scored, key, model, names)


def assemble_pipeline(prep: PipelineModel, model) -> PipelineModel:
    """Preprocessor and model as one persistable pipeline."""
    return PipelineModel(stages=[*prep.stages, model])

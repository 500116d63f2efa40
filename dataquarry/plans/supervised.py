"""Supervised analysis: split, tests, collinearity, model choice, evaluation, attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.columns import is_number
from dataquarry.operators.features import build_preprocessor, label_encode, transform_features
from dataquarry.operators.metrics import top_k_importance
from dataquarry.operators.sampling import kfold_assign, train_test_split
from dataquarry.operators.stats import P_VALUE_LIMIT, VIF_LIMIT, select_by_pvalue, vif_prune
from dataquarry.operators.supervised import (
    MODELS,
    assemble_pipeline,
    cross_validate,
    evaluate,
    feature_attribution,
    make_model,
    select_model,
    training_rows,
)
from dataquarry.runtime import materialise
from dataquarry.sources.phases import Phases


@dataclass
class SupervisedResult:
    task: str
    target: str
    selection: DataFrame
    vif: DataFrame
    scores: DataFrame
    choice: DataFrame
    winner: str
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    attribution: DataFrame
    p_threshold: float = P_VALUE_LIMIT
    vif_threshold: float = VIF_LIMIT


def run_supervised(
    df: DataFrame,
    key: str,
    target: str,
    task: str,
    p_threshold: float = P_VALUE_LIMIT,
    vif_threshold: float = VIF_LIMIT,
    models: tuple[str, ...] = MODELS,
    rounds: int = 100,
    trees: int = 100,
    phases: Phases | None = None,
) -> SupervisedResult:
    """The whole analysis; rows are identified by ``key``, which is not a feature.

    ``phases`` publishes every phase, so that a repeated run goes on after the last one.
    """
    phases = phases or Phases()
    if task not in {"classification", "regression"}:
        raise ValueError("task must be 'classification' or 'regression'")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    if task == "classification":
        labelled = label_encode(df, target, "label")
    else:
        labelled = df.withColumn("label", F.col(target).cast("double"))
    by = "label" if task == "classification" else None
    split = phases.step("split", lambda: {"rows": train_test_split(labelled, key, by)})["rows"]
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    features = train.drop(key, target, "is_test")
    fields = {f.name: f for f in features.schema}

    def select() -> dict:
        found = materialise(select_by_pvalue(features, "label", task, p_threshold), "selection")
        audit = found.orderBy("ordinal").collect()
        numeric = [r["feature"] for r in audit if r["approved"] and is_number(fields[r["feature"]])]
        return {"selection": found, "vif": vif_prune(train, numeric, {r["feature"]: r["p"] for r in audit}, vif_threshold)}

    selected = phases.step("selection", select)
    selection, vif = selected["selection"].orderBy("ordinal"), selected["vif"]
    approved = [r["feature"] for r in selection.filter("approved").collect()]
    removed = {r["feature"] for r in vif.filter("removed_at is not null").collect()}
    numeric = [c for c in approved if is_number(fields[c], booleans=True) and c not in removed]
    categorical = [c for c in approved if not is_number(fields[c], booleans=True)]
    if not numeric and not categorical:
        raise ValueError("no feature is left after selection")
    kept = train.select(key, "label", *numeric, *categorical)

    def compare() -> dict:
        folded = materialise(kfold_assign(kept, key, by), "folds")
        scores = materialise(
            cross_validate(folded, numeric, categorical, task, models=models, rounds=rounds, trees=trees), "scores"
        )
        return {"scores": scores, "choice": select_model(scores)}

    compared = phases.step("comparison", compare)
    winner = compared["choice"].first()["winner"]

    def fit() -> dict:
        usable = kept.filter("label is not null")
        prep, names = build_preprocessor(usable, numeric, categorical)
        rows = training_rows(transform_features(prep, usable))
        classes = rows.select("label").distinct().count() if task == "classification" else 0
        estimator = make_model(winner, task, rows.count(), classes, rounds, trees).fit(rows)
        held = transform_features(prep, test.filter("label is not null").select(key, "label", *numeric, *categorical))
        predictions = estimator.transform(held)
        return {
            "model": assemble_pipeline(prep, estimator),
            "predictions": predictions,
            "metrics": evaluate(predictions, task),
            "attribution": top_k_importance(feature_attribution(held, key, estimator, names, task), "mean_abs"),
        }

    fitted = phases.step("model", fit)
    return SupervisedResult(
        task, target, selection, vif, compared["scores"], compared["choice"], winner, fitted["model"],
        fitted["predictions"], fitted["metrics"], fitted["attribution"], p_threshold, vif_threshold,
    )

"""Unsupervised analysis: outliers, feature space, components, k-means, profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from dataquarry.operators.anomaly import isolation_forest
from dataquarry.operators.cluster import (
    build_feature_space,
    cluster_differentiators,
    cluster_profile_categorical,
    cluster_profile_numeric,
    kmeans_sweep,
    pca_reduce,
    variance_table,
)
from dataquarry.operators.columns import is_number, numeric_columns, split_inliers_outliers, union_inliers_outliers
from dataquarry.operators.features import transform_features
from dataquarry.runtime import materialise
from dataquarry.sources.phases import Phases


@dataclass
class ClusterResult:
    rows: DataFrame
    sweep: DataFrame
    variance: DataFrame
    differentiators: DataFrame
    numeric_profiles: DataFrame | None
    categorical_profiles: DataFrame | None
    model: PipelineModel


def run_clustering(df: DataFrame, key: str, trees: int = 100, phases: Phases | None = None) -> ClusterResult:
    """Cluster the inliers, profile the clusters, and put the anomalies back as cluster -1.

    ``phases`` publishes every phase, so that a repeated run goes on after the last one.
    """
    phases = phases or Phases()
    columns = numeric_columns(df, exclude=[key])
    labelled = phases.step("outliers", lambda: {"rows": isolation_forest(df, key, columns, trees=trees)})["rows"]
    inliers, outliers = split_inliers_outliers(labelled, "__anomaly_label__")

    def fit() -> dict:
        prep, _ = build_feature_space(inliers, key)
        space = materialise(transform_features(prep, inliers), "space")
        reduced, stages, ratios = pca_reduce(space)
        sweep, kmeans, clustered = kmeans_sweep(reduced, key)
        return {
            "rows": clustered.select(*df.columns, "Cluster_ID"),
            "sweep": sweep,
            "variance": variance_table(df.sparkSession, ratios),
            "model": PipelineModel(stages=[*prep.stages, *stages, kmeans]),
        }

    fitted = phases.step("clusters", fit)
    clustered = fitted["rows"]

    def describe() -> dict:
        differing = materialise(cluster_differentiators(clustered, skip=[key]), "differing")
        chosen = [r["feature"] for r in differing.filter("key").orderBy("ordinal").collect()]
        numeric = [c for c in chosen if is_number(df.schema[c])]
        others = [c for c in chosen if c not in numeric]
        return {
            "differentiators": differing,
            "numeric": cluster_profile_numeric(clustered, "Cluster_ID", numeric) if numeric else None,
            "categorical": cluster_profile_categorical(clustered, "Cluster_ID", others) if others else None,
        }

    profiles = phases.step("profiles", describe)
    return ClusterResult(
        rows=union_inliers_outliers(clustered, outliers),
        sweep=fitted["sweep"],
        variance=fitted["variance"],
        differentiators=profiles["differentiators"],
        numeric_profiles=profiles["numeric"],
        categorical_profiles=profiles["categorical"],
        model=fitted["model"],
    )

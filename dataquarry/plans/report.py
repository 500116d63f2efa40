"""Reports as tables ``(section, item, value)``; drawing and formatting are left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.functions.vectors import as_array
from dataquarry.operators.metrics import cv_summary


def section(df: DataFrame, name: str, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selection_report(selection: DataFrame, vif: DataFrame) -> DataFrame:
    """What was tested, approved, pruned, and the share of features lost altogether."""
    lost = selection.join(vif.select("feature", "removed_at"), "feature", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("approved")).alias("rejected"),
        F.count_if("approved").alias("approved"),
        F.count("removed_at").alias("removed"),
    )
    gone = F.col("rejected") + F.col("removed")
    items = {
        "features": F.col("n"), "approved": F.col("approved"), "rejected": F.col("rejected"),
        "removed_by_vif": F.col("removed"), "lost_share": F.round(gone / F.col("n"), 4),
    }
    counts = lost.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("item"), value.cast("double").alias("value")) for name, value in items.items()
    ])))
    verdict = F.when(F.col("approved"), "approved").otherwise("rejected")
    return _union([
        section(counts, "selection", F.col("item"), F.col("value")),
        section(selection, "hypothesis", F.col("feature"), verdict),
        section(vif, "vif", F.col("feature"), F.when(F.col("removed_at").isNull(), "kept").otherwise("removed")),
    ])


def supervised_report(result) -> DataFrame:
    """Selection and its thresholds, fold scores and their spread, the choice, test metrics and attribution."""
    spark = result.metrics.sparkSession
    limits = spark.createDataFrame(
        [("p_value", float(result.p_threshold)), ("vif", float(result.vif_threshold))], "item string, value double"
    )
    folds = cv_summary(result.scores)
    return _union([
        section(limits, "threshold", F.col("item"), F.col("value")),
        selection_report(result.selection, result.vif),
        section(folds, "cv_mean", F.col("model"), F.round("mean", 6)),
        section(folds, "cv_std", F.col("model"), F.round("std", 6)),
        section(result.choice, "choice", F.col("winner"), F.round("p", 6)),
        section(result.metrics, "test_metrics", F.col("metric"), F.round("value", 6)),
        section(result.attribution, "attribution", F.col("feature"), F.round("mean_abs", 6)),
    ])


def cluster_report(result) -> DataFrame:
    """Sizes, anomalies, the sweep's measures, components, and what tells the clusters apart."""
    sizes = result.rows.groupBy("Cluster_ID").agg(F.count(F.lit(1)).alias("n"))
    anomalies = result.rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("Cluster_ID") == -1).alias("anomalies")
    )
    best = result.sweep.filter("best")
    place = F.concat_ws(":", "cluster", "column")
    parts = [
        section(anomalies, "rows", F.lit("rows"), F.col("rows")),
        section(anomalies, "rows", F.lit("anomalies"), F.col("anomalies")),
        section(sizes, "cluster_size", F.col("Cluster_ID"), F.col("n")),
        section(best, "best_k", F.col("k"), F.round("score", 6)),
        section(result.sweep, "silhouette", F.col("k"), F.round("silhouette", 6)),
        section(result.sweep, "davies_bouldin", F.col("k"), F.round("davies_bouldin", 6)),
        section(result.differentiators.filter("key"), "differentiator", F.col("feature"), F.col("test")),
    ]
    if result.numeric_profiles is not None:
        parts.append(section(result.numeric_profiles, "cluster_median", place, F.round("median", 6)))
        parts.append(section(result.numeric_profiles, "cluster_mean", place, F.round("mean", 6)))
    if result.categorical_profiles is not None:
        parts.append(section(result.categorical_profiles, "cluster_mode", place, F.col("mode")))
    return _union(parts)


def topic_report(result) -> DataFrame:
    """Row count and shape of the vectors; topics, keywords and contexts, where the analysis went that far."""
    vec = next(c for c in ("reduced", "vector") if c in result.vectors.columns)
    shape = result.vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(as_array(result.vectors, vec))).alias("dims"))
    parts = [
        section(shape, "vectors", F.lit("rows"), F.col("rows")),
        section(shape, "vectors", F.lit("dimensions"), F.col("dims")),
    ]
    if result.stats is not None:
        parts += [
            section(result.stats, "topics", F.lit("n_rows"), F.col("n_rows")),
            section(result.stats, "topics", F.lit("n_topics"), F.col("n_topics")),
            section(result.stats, "topics", F.lit("noise_pct"), F.round("noise_pct", 4)),
        ]
    if result.keywords is not None:
        parts.append(section(result.keywords, "keyword", F.concat_ws(":", F.col("Topic_ID"), F.col("rank")), F.col("term")))
    if result.payload is not None:
        texts = result.payload.select("Topic_ID", F.posexplode("context").alias("n", "text"))
        parts.append(section(texts, "context", F.concat_ws(":", F.col("Topic_ID"), F.col("n") + 1), F.col("text")))
    return _union(parts)

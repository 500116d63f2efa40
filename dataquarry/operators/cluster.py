"""Feature space, dimension reduction, k-means search, cluster quality and profiles."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.vectors import as_array, as_vector, euclidean
from dataquarry.operators.columns import categorical_columns, col, numeric_columns
from dataquarry.operators.features import build_preprocessor
from dataquarry.operators.neighbors import BLOCK_ROWS, _stack, blocks_for, distances_to_labels, tile_pairs
from dataquarry.operators.ordered import exact_quantiles
from dataquarry.operators.stats import P_VALUE_LIMIT, anova_by_class, chi2_independence, with_p_values
from dataquarry.runtime import balance, concurrently, materialise

log = logging.getLogger(__name__)

VARIANCE_SHARE = 0.80
KMEANS_ITERATIONS = 100


def build_feature_space(df: DataFrame, key: str | None = None) -> tuple[PipelineModel, list[str]]:
    """Scaling and one-hot encoding of all columns, no imputation."""
    skip = [key] if key else []
    return build_preprocessor(df, numeric_columns(df, exclude=skip), categorical_columns(df, exclude=skip), impute=False)


def cumulative_variance(ratios: DataFrame, share: float = VARIANCE_SHARE) -> DataFrame:
    """``(component, ratio, cumulative, needed)``; ``needed`` marks the components up to the share."""
    order = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("cumulative") - F.col("ratio")
    return ratios.withColumn("cumulative", F.sum("ratio").over(order)).withColumn("needed", before < share)


def pca_reduce(df: DataFrame, vec: str = "features", share: float = VARIANCE_SHARE, out: str = "reduced", k: int | None = None):
    """Project on the fewest principal components that explain ``share`` of the variance.

    Returns ``(df with out, fitted stages, variance ratios)``; the stages persist.
    One fit: the projection keeps the first columns of the full decomposition.
    MLlib does not centre when it projects, hence the scaler.
    """
    vectors = df.withColumn(vec, as_vector(df, vec))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol=vec, outputCol="_centred").fit(vectors)
    centred = scaler.transform(vectors)
    d = int(scaler.mean.size)
    model = PCA(k=d, inputCol="_centred", outputCol="_pc").fit(centred)
    ratios = np.asarray(model.explainedVariance.toArray())
    reached = np.flatnonzero(np.cumsum(ratios) >= share - 1e-12)
    m = k or (int(reached[0]) + 1 if len(reached) else d)
    if k is None and m > math.ceil(0.70 * d):
        log.warning("little structure: %d of %d components for %.0f%% of the variance", m, d, 100 * share)
    # A component's sign is arbitrary: make its largest loading positive.
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(m)]
    stages = [
        scaler,
        model,
        VectorSlicer(inputCol="_pc", outputCol="_first", indices=list(range(m))),
        ElementwiseProduct(inputCol="_first", outputCol=out, scalingVec=Vectors.dense(signs)),
    ]
    reduced = PipelineModel(stages).transform(vectors)
    return reduced.select(*[col(c) for c in df.columns], out), stages, ratios


def variance_table(spark, ratios: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratios, 1)], "component int, ratio double")


def cluster_centroids(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, n, centroid)``, noise (-1) left out; partial sums are combined before the shuffle."""
    return (
        df.filter(F.col(label) != -1)
        .groupBy(*by, F.col(label).cast("int").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(as_vector(df, vec)).alias("c"))
        .select(*by, "label", "n", vector_to_array("c").alias("centroid"))
    )


def silhouettes(df: DataFrame, key: str, vec: str, labels: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, which, label, a, b, s)``: exact Euclidean silhouette of each row in each labelling; singletons score 0."""
    sums = distances_to_labels(df, key, vec, labels, block_rows)
    own = F.col("label") == F.col("own")
    per = sums.groupBy("key", "which", "own").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    s = F.when((F.col("size") > 1) & F.col("b").isNotNull() & (widest > 0), (F.col("b") - F.col("a")) / widest).otherwise(0.0)
    return per.select("key", "which", F.col("own").alias("label"), "a", "b", s.alias("s"))


def silhouette(df: DataFrame, key: str, vec: str, label: str, distance: str = "euclidean") -> DataFrame:
    """``(silhouette, distance)``: the mean over all rows.

    ``euclidean`` is exact and quadratic in the rows; ``squared_euclidean`` is
    another, linear-cost measure from cluster sums alone.  Both use every row.
    """
    if distance == "euclidean":
        rows = silhouettes(df.withColumn("_labels", F.array(F.col(label).cast("int"))), key, vec, "_labels")
        return rows.agg(F.avg("s").alias("silhouette"), F.lit(distance).alias("distance"))
    if distance != "squared_euclidean":
        raise ValueError("distance must be 'euclidean' or 'squared_euclidean'")
    evaluator = ClusteringEvaluator(featuresCol="_v", predictionCol="_label", distanceMeasure="squaredEuclidean")
    value = evaluator.evaluate(df.select(as_vector(df, vec).alias("_v"), F.col(label).cast("double").alias("_label")))
    return df.sparkSession.createDataFrame([(float(value), distance)], "silhouette double, distance string")


def _spreads(df: DataFrame, vec: str, label: str, by: Sequence[str]) -> DataFrame:
    """``(by..., label, centroid, spread)``: mean distance of the rows to their centroid."""
    # Written: one row per cluster, so rows meet their centroid by broadcast when that is small.
    centroids = materialise(cluster_centroids(df, vec, label, by), "centroids")
    rows = df.filter(F.col(label) != -1).select(*by, F.col(label).cast("int").alias("label"), as_array(df, vec).alias("v"))
    return (
        rows.join(centroids, [*by, "label"])
        .withColumn("d", euclidean(F.col("v"), F.col("centroid")))
        .groupBy(*by, "label")
        .agg(F.avg("d").alias("spread"))
        .join(centroids, [*by, "label"])
        .select(*by, "label", "centroid", "spread")
    )


def davies_bouldin(df: DataFrame, vec: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., davies_bouldin)``: mean over clusters of the worst ``(S_i + S_j) / M_ij``."""
    by = list(by)
    spreads = _spreads(df, vec, label, by)
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    parts = materialise(
        spreads.select(*by, group.alias("group"), F.concat_ws("/", group, "label").alias("code"), "centroid", "spread"), "spreads"
    )

    def worst(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"code": [], "worst": []})
        a, b = _stack(x["centroid"]), _stack(y["centroid"])
        gap = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        both = x["spread"].to_numpy()[:, None] + y["spread"].to_numpy()[None, :]
        ratio = np.divide(both, gap, out=np.zeros_like(gap), where=gap > 0)
        other = x["code"].to_numpy()[:, None] != y["code"].to_numpy()[None, :]
        same_group = x["group"].to_numpy()[:, None] == y["group"].to_numpy()[None, :]
        return pd.DataFrame({"code": x["code"], "worst": np.where(other & same_group, ratio, 0.0).max(axis=1)})

    n = blocks_for(parts.count(), 256)
    pairs = tile_pairs(parts, parts, "code", "code", (n, n), worst, "code string, worst double")
    per = pairs.groupBy("code").agg(F.max("worst").alias("worst"))
    if by:
        per = per.join(parts.select(*by, "code"), "code")
    return per.groupBy(*by).agg(F.avg("worst").alias("davies_bouldin"))


def combined_score(sil: float, db: float) -> float:
    return 0.6 * (sil + 1.0) / 2.0 + 0.4 / (1.0 + db)


def cluster_score(df: DataFrame, key: str, vec: str, label: str, distance: str = "euclidean") -> DataFrame:
    """``(silhouette, davies_bouldin, score)`` of given labels."""
    sil = silhouette(df, key, vec, label, distance).select(F.lit(1).alias("_"), "silhouette")
    db = davies_bouldin(df, vec, label).select(F.lit(1).alias("_"), "davies_bouldin")
    score = 0.6 * (F.col("silhouette") + 1.0) / 2.0 + 0.4 / (1.0 + F.col("davies_bouldin"))
    return sil.join(db, "_").select("silhouette", "davies_bouldin", score.alias("score"))


def squared_silhouettes(df: DataFrame, vec: str, labels: str) -> dict[int, float]:
    """``{which: mean}`` of the squared-Euclidean silhouette of every labelling in the array ``labels``.

    A point's mean squared distance to a cluster follows from the cluster's size, sum and
    sum of squared norms, so one pass sums those for all labellings and a second one
    scores the rows.  The driver holds one vector per cluster and labelling.
    """
    rows = df.select(as_vector(df, vec).alias("v"), F.col(labels).alias("labels"))
    long = rows.select("v", F.posexplode("labels").alias("which", "label"))
    sums = long.groupBy("which", "label").agg(Summarizer.metrics("count", "sum", "normL2").summary(F.col("v")).alias("s"))
    found = sums.select("which", "label", "s.count", "s.sum", "s.normL2").collect()
    clusters: dict[int, dict] = {}
    for r in found:
        clusters.setdefault(r["which"], {})[r["label"]] = (r["count"], r["sum"].toArray(), float((r["normL2"].toArray() ** 2).sum()))

    def score(batches):
        for batch in batches:
            x = _stack(batch["v"])
            own = _stack(batch["labels"]).astype(int)
            norms = (x**2).sum(axis=1)
            out = []
            for which, parts in clusters.items():
                names = np.array(sorted(parts))
                n = np.array([parts[c][0] for c in names], float)
                total = np.stack([parts[c][1] for c in names])
                square = np.array([parts[c][2] for c in names])
                # Sums of squared distances of every row to every cluster.
                gaps = np.maximum(norms[:, None] * n + square - 2 * x @ total.T, 0.0)
                at = np.searchsorted(names, own[:, which])
                row = np.arange(len(x))
                size = n[at]
                a = np.divide(gaps[row, at], size - 1, out=np.zeros(len(x)), where=size > 1)
                means = gaps / n
                means[row, at] = np.inf
                b = means.min(axis=1)
                widest = np.maximum(a, b)
                fit = (size > 1) & np.isfinite(b) & (widest > 0)
                s = np.divide(b - a, widest, out=np.zeros(len(x)), where=fit)
                out.append((which, float(s.sum()), len(x)))
            yield pd.DataFrame(out, columns=["which", "s", "n"])

    scored = rows.select(vector_to_array("v").alias("v"), "labels").mapInPandas(score, "which int, s double, n bigint")
    return {r["which"]: r["s"] / r["n"] for r in scored.groupBy("which").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}


def combined(rows: DataFrame, vec: str, weight: str = "_rows") -> DataFrame | None:
    """``(vec, weight)``: the distinct vectors and how many rows hold them; None unless they are at most half of the rows."""
    points = materialise(rows.groupBy(vec).agg(F.count(F.lit(1)).cast("double").alias(weight)), "sweep-points")
    distinct, n = points.agg(F.count(F.lit(1)), F.sum(weight)).first()
    return balance(points, "sweep-points") if distinct and 2 * distinct <= n else None


def kmeans_sweep(df: DataFrame, key: str, vec: str = "reduced", seed: int = 42, distance: str = "squared_euclidean"):
    """Try k = 2..max(2, min(10, n // 10)); returns ``(table, best model, labelled rows)``.

    ``table`` is ``(k, silhouette, davies_bouldin, score, best, distance)``; the
    smallest k wins ties.  ``distance`` names the silhouette's measure at every table
    size: ``squared_euclidean`` costs a pass over the rows, ``euclidean`` grows with their square.
    Where vectors repeat, the models are fitted on the distinct ones, weighted by their rows.
    """
    if distance not in ("euclidean", "squared_euclidean"):
        raise ValueError("distance must be 'euclidean' or 'squared_euclidean'")
    # Every fit passes over the rows up to a hundred times.
    rows = balance(df.select(F.col(key), as_vector(df, vec).alias(vec)), "sweep-rows").persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    if n < 4:
        raise ValueError("at least 4 rows are needed to compare clusterings")
    ks = list(range(2, max(2, min(10, n // 10)) + 1))
    points = combined(rows, vec)
    weights, trained = ({}, rows) if points is None else ({"weightCol": "_rows"}, points.persist(StorageLevel.MEMORY_AND_DISK))
    options = {"seed": seed, "maxIter": KMEANS_ITERATIONS, "featuresCol": vec, **weights}
    fit = lambda k: KMeans(k=k, predictionCol=f"_k{k}", **options).fit(trained)
    models = dict(zip(ks, concurrently(df.sparkSession, fit, ks)))
    if points is not None:
        trained.unpersist()
    labelled = rows
    for k in ks:
        labelled = models[k].transform(labelled)
    labelled = materialise(labelled.withColumn("_labels", F.array(*[f"_k{k}" for k in ks])), "sweep")
    if distance == "euclidean":
        found = silhouettes(labelled, key, vec, "_labels").groupBy("which").agg(F.avg("s").alias("s")).collect()
        sil = {ks[r["which"]]: r["s"] for r in found}
    else:
        sil = {ks[which]: s for which, s in squared_silhouettes(labelled, vec, "_labels").items()}
    long = labelled.select(vec, F.posexplode("_labels").alias("which", "label"))
    db = {ks[r["which"]]: r["davies_bouldin"] for r in davies_bouldin(long, vec, "label", ["which"]).collect()}
    rows.unpersist()
    best, table = None, []
    for k in ks:
        score = combined_score(sil[k], db[k])
        table.append((k, float(sil[k]), float(db[k]), float(score)))
        if best is None or score > best[0]:
            best = (score, k, models[k].setPredictionCol("Cluster_ID"))
    schema = "k int, silhouette double, davies_bouldin double, score double, best boolean, distance string"
    swept = df.sparkSession.createDataFrame([(*r, r[0] == best[1], distance) for r in table], schema)
    labels = best[2].transform(df.withColumn(vec, as_vector(df, vec)))
    return swept, best[2], labels


def cluster_differentiators(df: DataFrame, cluster: str = "Cluster_ID", skip: Sequence[str] = (), threshold: float = P_VALUE_LIMIT) -> DataFrame:
    """``(ordinal, feature, test, stat, dof1, dof2, p, key)``: numeric columns first, then the others."""
    numeric = numeric_columns(df, exclude=[cluster, *skip])
    others = categorical_columns(df, exclude=[cluster, *skip])
    parts = []
    if numeric:
        parts.append(anova_by_class(df, cluster, numeric))
    if others:
        parts.append(chi2_independence(df, cluster, others))
    if not parts:
        raise ValueError("no column to compare clusters by")
    tests = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = df.sparkSession.createDataFrame(list(enumerate([*numeric, *others], 1)), "ordinal int, feature string")
    p = F.coalesce("p", F.lit(1.0))
    return order.join(with_p_values(tests), "feature", "left").select(
        "ordinal", "feature", "test", "stat", "dof1", "dof2", p.alias("p"), (p < threshold).alias("key")
    )


def cluster_profile_numeric(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """``(cluster, size, column, median, mean, std)``; medians are exact."""
    columns = list(columns)
    cells = df.select(
        F.col(cluster).alias("cluster"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("x")) for c in columns])),
    )
    stats = cells.groupBy("cluster", "column").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")
    )
    medians = exact_quantiles(df, columns, [0.5], [cluster]).select(
        F.col(cluster).alias("cluster"), F.col("feature").alias("column"), F.col("q")[0].alias("median")
    )
    return stats.join(medians, ["cluster", "column"], "left").select("cluster", "size", "column", "median", "mean", "std")


def category_counts(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """``(cluster, column, value, n)`` in long form."""
    cells = df.select(
        F.col(cluster).alias("cluster"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])),
    )
    return cells.filter("value is not null").groupBy("cluster", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def cluster_profile_categorical(df: DataFrame, cluster: str, columns: Sequence[str], maps: bool = False) -> DataFrame:
    """``(cluster, column, mode, mode_count)``; ``category_counts`` has all counts in long form.

    With ``maps`` a column ``categories`` maps every value to its count, for columns
    whose values the caller knows to be few.
    """
    counts = category_counts(df, cluster, columns)
    top = F.min(F.struct((-F.col("n")).alias("neg"), "value"))
    out = [top.alias("top")]
    if maps:
        out.append(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("categories"))
    return counts.groupBy("cluster", "column").agg(*out).select(
        "cluster", "column", F.col("top.value").alias("mode"), (-F.col("top.neg")).alias("mode_count"), *(["categories"] if maps else [])
    )


def cluster_boxplot(df: DataFrame, by: str, column: str) -> DataFrame:
    """``(by, n, low, q1, median, q3, high)`` of one column per group, exact."""
    q = F.col("q")
    return exact_quantiles(df, [column], [0.0, 0.25, 0.5, 0.75, 1.0], [by]).select(
        by, "n", *[q[i].alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))]
    )


def scatter_points(df: DataFrame, key: str, vec: str, cluster: str) -> DataFrame:
    """Every row with its first two coordinates, for a plot."""
    rows = df.select(key, cluster, as_array(df, vec).alias("_a"))
    return rows.select(key, cluster, F.get("_a", F.lit(0)).alias("pca1"), F.get("_a", F.lit(1)).alias("pca2"))

"""Hypothesis tests, correlation and variance inflation from sufficient statistics.

Spark computes group counts, means and variances; what is left per tested feature
is one row, on which the tail probability is evaluated.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.functions.hashing import value_key
from dataquarry.functions.scalars import safe_float
from dataquarry.functions.tails import p_value
from dataquarry.operators.columns import categorical_columns, col, numeric_columns
from dataquarry.runtime import materialise

P_VALUE_LIMIT = 0.05
VIF_LIMIT = 10.0
TEST_COLUMNS = ["feature", "test", "stat", "dof1", "dof2"]


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form ``(a, b, n)``; rows with a null are left out."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.filter(col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns without nulls; null when one is constant.

    ``corr`` itself fails on a constant column in ANSI mode.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return safe_float(F.when(spread > 0, F.covar_pop(x, y) / spread))


def _class_key(df: DataFrame, target: str) -> Column:
    """The class as a group key; long texts by their digest."""
    return value_key(col(target)) if isinstance(df.schema[target].dataType, T.StringType) else col(target)


def _numeric_by_class(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(feature, grp, n, m, v)``: count, mean, variance of every column in every class."""
    cells = df.filter(col(target).isNotNull()).select(
        _class_key(df, target).alias("grp"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("x")) for c in columns])),
    )
    return cells.groupBy("feature", "grp").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")
    )


def _target_by_category(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """The same for a numeric target, grouped by the categories of each column."""
    cells = df.select(
        col(target).cast("double").alias("y"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), value_key(col(c).cast("string")).alias("grp")) for c in columns])),
    )
    return (
        cells.filter("grp is not null")
        .groupBy("feature", "grp")
        .agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    )


def _anova(groups: DataFrame) -> DataFrame:
    """One-way ANOVA per feature; no statistic with an empty group or one group only.

    The group statistics are used twice (the overall mean first), so they are
    written: otherwise the two uses prune different columns and scan the input twice.
    """
    groups = materialise(groups, "groups")
    grand = groups.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
        F.min("n").alias("least"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
    )
    sums = (
        groups.join(grand, "feature")
        .groupBy("feature", "total", "k", "least")
        .agg(
            F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("ssb"),
            F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"),
        )
    )
    dof1, dof2 = F.col("k") - 1, F.col("total") - F.col("k")
    usable = (F.col("least") > 0) & (dof1 > 0) & (dof2 > 0) & (F.col("ssw") > 0)
    stat = F.when(usable, (F.col("ssb") / dof1) / (F.col("ssw") / dof2))
    return sums.select(
        "feature", F.lit("anova").alias("test"), stat.alias("stat"),
        dof1.cast("int").alias("dof1"), dof2.cast("bigint").alias("dof2"),
    )


def anova_by_class(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """ANOVA of every numeric column over the classes of ``target``."""
    columns = numeric_columns(df, booleans=True, exclude=[target]) if columns is None else list(columns)
    return _anova(_numeric_by_class(df, target, columns))


def anova_by_category(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """ANOVA of a numeric ``target`` over the categories of every non-numeric column."""
    columns = categorical_columns(df, booleans=False, exclude=[target]) if columns is None else list(columns)
    return _anova(_target_by_category(df, target, columns))


def pearson_target(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, test, r, stat, dof1, dof2)``: correlation with the target and its t statistic."""
    columns = numeric_columns(df, booleans=True, exclude=[target]) if columns is None else list(columns)
    cells = df.filter(col(target).isNotNull()).select(
        col(target).cast("double").alias("y"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("x")) for c in columns])),
    )
    n, r = F.col("n"), F.col("r")
    usable = (n > 2) & r.isNotNull()
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    return (
        cells.filter("x is not null")
        .groupBy("feature")
        .agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
        .select(
            "feature", F.lit("pearson").alias("test"), "r", F.when(usable, t).alias("stat"),
            F.lit(1).alias("dof1"), (n - 2).alias("dof2"),
        )
    )


def chi2_independence(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Chi-square of every non-numeric column against ``target``; Yates-corrected for one degree of freedom."""
    columns = categorical_columns(df, booleans=False, exclude=[target]) if columns is None else list(columns)
    cells = (
        df.filter(col(target).isNotNull())
        .select(
            _class_key(df, target).alias("b"),
            F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), value_key(col(c).cast("string")).alias("a")) for c in columns])),
        )
        .filter("a is not null")
        .groupBy("feature", "a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("o"))
    )
    cells = materialise(cells, "cells")  # used by row, by column and by cell
    rows = cells.groupBy("feature", "a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("feature", "b").agg(F.sum("o").alias("c"))
    row_sums = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("nr"), F.sum("r").alias("n"), (F.min("r") * F.max("r")).alias("r_product")
    )
    col_sums = cols.groupBy("feature").agg(F.count(F.lit(1)).alias("nc"), (F.min("c") * F.max("c")).alias("c_product"))
    total = row_sums.join(col_sums, "feature")
    expected = F.col("r") * F.col("c") / F.col("n")
    parts = (
        cells.join(rows, ["feature", "a"])
        .join(cols, ["feature", "b"])
        .join(total.select("feature", "n"), "feature")
        .groupBy("feature")
        .agg(
            F.sum((F.col("o") - expected) * (F.col("o") - expected) / expected).alias("seen"),
            F.sum(expected).alias("covered"),
            F.max(F.abs(F.col("o") - expected)).alias("delta"),
            F.count(F.lit(1)).alias("filled"),
        )
    )
    n = F.col("n")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    # An empty cell adds its whole expected count.
    empty = F.when(F.col("filled") < F.col("nr") * F.col("nc"), n - F.col("covered")).otherwise(0.0)
    shrunk = F.greatest(F.col("delta") - 0.5, F.lit(0.0))
    yates = shrunk * shrunk * n * n * n / (F.col("r_product") * F.col("c_product"))
    stat = F.when(dof == 0, F.lit(None)).when(dof == 1, yates).otherwise(F.col("seen") + empty)
    return parts.join(total, "feature").select(
        "feature", F.lit("chi2").alias("test"), stat.cast("double").alias("stat"),
        dof.cast("int").alias("dof1"), n.cast("bigint").alias("dof2"),
    )


def hypothesis_tests(df: DataFrame, target: str, task: str) -> DataFrame:
    """The fitting test for every feature: ``(feature, test, stat, dof1, dof2)``."""
    if task not in {"classification", "regression"}:
        raise ValueError("task must be 'classification' or 'regression'")
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    numeric = numeric_columns(df, booleans=True, exclude=[target])
    others = categorical_columns(df, booleans=False, exclude=[target])
    parts = []
    if numeric:
        test = anova_by_class if task == "classification" else pearson_target
        parts.append(test(df, target, numeric).select(*TEST_COLUMNS))
    if others:
        test = chi2_independence if task == "classification" else anova_by_category
        parts.append(test(df, target, others).select(*TEST_COLUMNS))
    if not parts:
        raise ValueError("no feature to test")
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) == 2 else out


def with_p_values(tests: DataFrame) -> DataFrame:
    """Add ``p``; an undefined statistic has p = 1."""
    p = p_value(F.col("test"), F.col("stat"), F.col("dof1"), F.col("dof2"))
    return tests.withColumn("p", F.coalesce(p, F.lit(1.0)))


def select_by_pvalue(df: DataFrame, target: str, task: str, threshold: float = P_VALUE_LIMIT) -> DataFrame:
    """``(feature, ordinal, test, stat, dof1, dof2, p, approved)``, one row per feature."""
    features = [c for c in df.columns if c != target]
    names = df.sparkSession.createDataFrame(list(enumerate(features, 1)), "ordinal int, feature string")
    tested = with_p_values(hypothesis_tests(df, target, task))
    p = F.coalesce("p", F.lit(1.0))
    return names.join(tested, "feature", "left").select(
        "feature", "ordinal", "test", "stat", "dof1", "dof2", p.alias("p"), (p < threshold).alias("approved")
    )


def lookup_pvalues(features: DataFrame, tests: DataFrame) -> DataFrame:
    """Left lookup of the p-value per feature, 1.0 where there is none."""
    return features.join(tests.select("feature", "p"), "feature", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))


def lowest_p_feature(tests: DataFrame) -> DataFrame:
    """The feature with the smallest p; the first in column order on ties."""
    return tests.agg(F.min_by("feature", F.struct("p", "ordinal")).alias("feature"), F.min("p").alias("p"))


def paired_ttest(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``(stat, dof1, dof2)`` of model ``a`` against model ``b`` over the folds of ``(model, fold, score)``."""
    pairs = scores.groupBy("fold").agg(
        (F.max(F.when(F.col("model") == a, F.col("score"))) - F.max(F.when(F.col("model") == b, F.col("score")))).alias("d")
    )
    n = F.count("d")
    spread = F.stddev_samp("d")
    # A spread of rounding error only leaves t undefined, as identical scores do.
    usable = spread > 1e-12 * F.greatest(F.max(F.abs("d")), F.lit(1e-300))
    return pairs.agg(
        F.lit("paired_t").alias("test"),
        F.when(usable, F.avg("d") / (spread / F.sqrt(n))).alias("stat"),
        F.lit(1).alias("dof1"),
        (n - 1).alias("dof2"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, r)`` for every ordered pair of numeric columns, after listwise deletion."""
    columns = numeric_columns(df) if columns is None else list(columns)
    matrix = correlation_array(df, columns)
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_array(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The same matrix on the driver (columns x columns); NaN for constant columns and for less than two rows.

    One pass sums the products of the centred columns: a row stays one row, whatever the number of columns.
    """
    columns = list(columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(
        df.dropna(subset=columns).select(*[col(c).cast("double").alias(c) for c in columns])
    ).select("_v")
    if len(vectors.take(2)) < 2:
        return np.full((len(columns), len(columns)), np.nan)
    moments = vectors.select(Summarizer.metrics("min", "max").summary(F.col("_v")).alias("s")).select("s.*").first()
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray().copy()
    constant = moments["min"].toArray() == moments["max"].toArray()
    matrix[constant, :] = np.nan
    matrix[:, constant] = np.nan
    return matrix


class _Inflation:
    """Variance inflation of columns from their correlation matrix, while columns are removed one by one.

    One decomposition serves all columns: the inflation of a column is its diagonal
    element of the inverse, and infinite if a null direction of the matrix involves it.
    Without null directions the inverse is kept, and a removal is a rank-one update.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.left = list(range(len(matrix)))
        self.live = [j for j in self.left if not np.isnan(matrix[j, j])]
        self.inverse: np.ndarray | None = None

    def values(self) -> np.ndarray:
        """By place in ``left``; NaN for constant columns, inf for collinear ones."""
        found = {}
        if self.live:
            if self.inverse is None:
                sizes, vectors = np.linalg.eigh(self.matrix[np.ix_(self.live, self.live)])
                null = sizes <= 1e-10 * max(sizes[-1], 1.0)
                diagonal = (vectors[:, ~null] ** 2 / sizes[~null]).sum(axis=1)
                involved = (vectors[:, null] ** 2).sum(axis=1) > 1e-9
                diagonal[involved] = np.inf
                if not null.any():
                    self.inverse = (vectors / sizes) @ vectors.T
            else:
                diagonal = np.diag(self.inverse).copy()
            diagonal[diagonal > 1e9] = np.inf
            found = dict(zip(self.live, np.maximum(diagonal, 1.0)))
        return np.array([found.get(j, np.nan) for j in self.left])

    def remove(self, column: int) -> None:
        self.left.remove(column)
        if column in self.live:
            at = self.live.index(column)
            self.live.remove(column)
            if self.inverse is not None:
                rest = np.arange(len(self.inverse)) != at
                row = self.inverse[at, rest]
                self.inverse = self.inverse[np.ix_(rest, rest)] - np.outer(row, row) / self.inverse[at, at]


_VIF_SCHEMA = "feature string, vif double"


def vif_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, vif)`` after listwise deletion; null for a constant column."""
    columns = list(columns)
    values = _Inflation(correlation_array(df, columns)).values()
    rows = [(c, None if np.isnan(v) else float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, _VIF_SCHEMA)


def vif_candidate(scores: DataFrame) -> DataFrame:
    """The column to remove next from ``(feature, vif, p)``: largest p, then largest VIF."""
    return scores.orderBy(F.desc("p"), F.desc("vif"), "feature").limit(1)


def vif_prune(
    df: DataFrame,
    columns: Sequence[str],
    p_values: dict[str, float] | None = None,
    threshold: float = VIF_LIMIT,
    order: str = "p_value",
) -> DataFrame:
    """``(feature, vif, p, removed_at)``: remove columns until no VIF exceeds the threshold.

    ``removed_at`` numbers the removals from 1 and is null for survivors.  Spark
    reads the data once, for the correlation matrix; the loop shrinks the matrix.
    ``order='p_value'`` removes the least significant column first, ``'vif'`` the
    most inflated one.
    """
    if order not in {"p_value", "vif"}:
        raise ValueError("order must be 'p_value' or 'vif'")
    columns = list(columns)
    p = {c: (p_values or {}).get(c, 1.0) for c in columns}
    rows: dict[str, tuple] = {c: (c, None, float(p[c]), None) for c in columns}
    if len(columns) >= 2:
        inflation = _Inflation(correlation_array(df, columns))
        left = inflation.left
        step = 0
        while len(left) >= 2:
            vifs = inflation.values()
            for i, v in zip(left, vifs):
                rows[columns[i]] = (columns[i], None if np.isnan(v) else float(v), float(p[columns[i]]), None)
            if np.all(np.isnan(vifs)) or np.nanmax(vifs) <= threshold:
                break
            rank = {i: (0.0 if np.isnan(v) else v) for i, v in zip(left, vifs)}
            if order == "p_value":
                out = max(left, key=lambda i: (p[columns[i]], rank[i], -i))
            else:
                out = max(left, key=lambda i: (rank[i], p[columns[i]], -i))
            step += 1
            rows[columns[out]] = (*rows[columns[out]][:3], step)
            inflation.remove(out)
    return df.sparkSession.createDataFrame(list(rows.values()), "feature string, vif double, p double, removed_at int")

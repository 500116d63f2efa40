"""Column-level projections: masking, selection by type, splitting, row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "Var_{:02d}"


def is_number(field: T.StructField, booleans: bool = False) -> bool:
    """Numeric by type; ``booleans`` tells whether BOOLEAN counts as numeric."""
    return isinstance(field.dataType, T.NumericType) or (booleans and isinstance(field.dataType, T.BooleanType))


def numeric_columns(df: DataFrame, booleans: bool = False, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_number(f, booleans) and f.name not in skip]


def categorical_columns(df: DataFrame, booleans: bool = True, exclude: Iterable[str] = ()) -> list[str]:
    """Everything that is not numeric; BOOLEAN included unless told otherwise."""
    skip = set(exclude)
    return [f.name for f in df.schema if not is_number(f, not booleans) and f.name not in skip]


def select_numeric(df: DataFrame, **options) -> DataFrame:
    return df.select(*numeric_columns(df, **options))


def select_categorical(df: DataFrame, **options) -> DataFrame:
    return df.select(*categorical_columns(df, **options))


def mapping(df: DataFrame) -> dict[str, str]:
    """Real name -> masked name, by position.  Already masked names stay as they are."""
    masked = [MASK.format(i) for i in range(1, len(df.columns) + 1)]
    if set(df.columns) <= set(masked):
        return {c: c for c in df.columns}
    return dict(zip(df.columns, masked))


def mask_columns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename columns to ``Var_01...``; also return ``(ordinal, real, masked)``."""
    names = mapping(df)
    table = df.sparkSession.createDataFrame(
        [(i, real, masked) for i, (real, masked) in enumerate(names.items(), 1)],
        "ordinal int, real string, masked string",
    )
    return df.toDF(*names.values()), table


def unmask_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Masked column names back to the real ones."""
    back = {masked: real for real, masked in names.items()}
    return df.toDF(*[back.get(c, c) for c in df.columns])


def unmask_values(df: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """Replace masked names held in a report column; a key join, never a text replace."""
    names = table.select(F.col("masked").alias("_masked"), F.col("real").alias("_real"))
    # The mapping has one row per column of the analysed table.
    joined = df.join(F.broadcast(names), F.col(col) == F.col("_masked"), "left")
    return joined.withColumn(col, F.coalesce("_real", col)).drop("_masked", "_real")


def resolve(df: DataFrame, name: str, names: dict[str, str] | None = None) -> str:
    """The column meant by ``name``, given by its real or its masked name."""
    if name in df.columns:
        return name
    names = names or {}
    back = {masked: real for real, masked in names.items()}
    for candidate in (names.get(name), back.get(name)):
        if candidate in df.columns:
            return candidate
    raise ValueError(f"column '{name}' not found")


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    return df.drop(target), df.select(target)


def prune_to_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *numeric, *categorical)


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def pairwise_not_null(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def split_inliers_outliers(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows labelled 1, and rows labelled -1 with ``__anomaly__ = -1``."""
    inliers = df.filter(F.col(label) == 1).drop(label)
    outliers = df.filter(F.col(label) == -1).drop(label).withColumn("__anomaly__", F.lit(-1))
    return inliers, outliers


def union_inliers_outliers(clustered: DataFrame, outliers: DataFrame, cluster: str = "Cluster_ID") -> DataFrame:
    """Clustered inliers together with the anomalies, which get cluster -1."""
    return clustered.unionByName(outliers.withColumn(cluster, F.lit(-1)), allowMissingColumns=True)


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels in use, noise (-1) left out."""
    return df.select(label).distinct().filter(F.col(label) != -1)


def filter_noise(df: DataFrame, topic: str) -> DataFrame:
    return df.filter(F.col(topic) != -1)


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str, default: int = -1) -> DataFrame:
    """Left join of labels by key; rows without one get ``default``."""
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def column_set_diff(all_features: DataFrame, kept: DataFrame, col: str = "feature") -> DataFrame:
    """Features of the first table that the second one lacks."""
    return all_features.select(col).join(kept.select(col), col, "left_anti")


def col(name: str) -> Column:
    return F.col(f"`{name}`")

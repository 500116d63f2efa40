"""Turning columns into model inputs: scaling, one-hot encoding, label encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.clean import fill_nulls, fill_values
from dataquarry.operators.columns import col
from dataquarry.operators.ordered import quantiles_of, running_totals
from dataquarry.runtime import materialise

# One-hot encoding keeps the list of categories in the model: refuse identifiers.
# The limit is an argument and judged by the exact number of values.
MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class Scaling:
    """Centre and width of one column; a zero width divides by one."""

    center: float
    width: float


def fit_robust_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, Scaling]:
    out = {}
    for c, (q1, q2, q3) in quantiles_of(df, list(columns), [0.25, 0.5, 0.75]).items():
        width = (q3 - q1) if q1 is not None else 0.0
        out[c] = Scaling(q2 if q2 is not None else 0.0, width or 1.0)
    return out


def apply_scaling(df: DataFrame, scaling: dict[str, Scaling]) -> DataFrame:
    return df.withColumns({c: (col(c).cast("double") - s.center) / s.width for c, s in scaling.items()})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - median) / IQR`` in place, exact quartiles."""
    return apply_scaling(df, fit_robust_scaling(df, columns))


def label_encode(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Sorted distinct classes become 0..k-1 in column ``out``; nulls stay null."""
    classes = df.select(F.col(target).alias("_class")).filter("_class is not null").distinct().withColumn("_one", F.lit(1))
    coded = running_totals(classes, ["_class"], {"_code": "_one"}, "classes").select("_class", F.col("_code").cast("int").alias(out))
    # Written, so that its size decides how it is joined: classes are few, rows per class many.
    coded = materialise(coded, "codes")
    return df.join(coded, F.col(target) == F.col("_class"), "left").drop("_class")


def fit_impute(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Fill values learnt on the training rows only."""
    return fill_values(train, numeric, categorical)


def apply_impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return fill_nulls(df, fills)


def check_categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> None:
    """Refuse columns with more distinct values than a model should memorise, by their exact number."""
    if not columns:
        return
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])))
    counts = cells.filter("value is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    wide = sorted(r["column"] for r in counts.filter(F.col("n") > limit).collect())
    if wide:
        raise ValueError(f"more than {limit} categories in {', '.join(wide)}")


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> PipelineModel:
    """Fit ``<column>__hot`` indicators of the known values; unknown and null give zeros."""
    check_categories(df, columns, max_categories)
    stages = [_as_strings(columns), *_one_hot_stages([f"{c}__str" for c in columns], list(columns))]
    return Pipeline(stages=stages).fit(df)


def _as_strings(columns: Sequence[str]) -> SQLTransformer:
    casts = ", ".join(f"cast(`{c}` as string) as `{c}__str`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__")


def _one_hot_stages(inputs: list[str], names: list[str]) -> list:
    index = StringIndexer(
        inputCols=inputs, outputCols=[f"{c}__idx" for c in names],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    # "keep" adds a last slot for unknown values, and dropLast removes exactly that slot.
    encode = OneHotEncoder(
        inputCols=[f"{c}__idx" for c in names], outputCols=[f"{c}__hot" for c in names], dropLast=True
    )
    return [index, encode]


def one_hot_labels(model: PipelineModel) -> list[list[str]]:
    """The known values of every encoded column, in slot order."""
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            return [list(labels) for labels in stage.labelsArray]
    return []


def _sql_string(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def build_preprocessor(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    impute: bool = True,
    out: str = "features",
    max_categories: int = MAX_CATEGORIES,
) -> tuple[PipelineModel, list[str]]:
    """Fit imputation, robust scaling and one-hot encoding on ``train``.

    Returns a persistable ``PipelineModel`` that adds the vector ``out``, and the
    feature names in vector order (``num__x``, ``cat__column_value``).  The fitted
    fills and scales are literals of one SQL projection, so transforming is a single
    JVM pass.
    """
    numeric, categorical = list(numeric), list(categorical)
    if not numeric and not categorical:
        raise ValueError("no column to build features from")
    check_categories(train, categorical, max_categories)
    quartiles = quantiles_of(train, numeric, [0.25, 0.5, 0.75])
    modes = fill_values(train, modes=categorical) if impute else {}
    exprs = []
    for c, (q1, q2, q3) in quartiles.items():
        center = 0.0 if q2 is None else float(q2)
        width = (float(q3) - float(q1)) if q1 is not None else 0.0
        x = f"cast(`{c}` as double)"
        x = f"coalesce({x}, {center!r}D)" if impute else x
        exprs.append(f"({x} - ({center!r}D)) / {(width or 1.0)!r}D as `{c}__num`")
    for c in categorical:
        x = f"cast(`{c}` as string)"
        exprs.append((f"coalesce({x}, {_sql_string(modes[c])})" if modes.get(c) is not None else x) + f" as `{c}__str`")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if categorical:
        stages += _one_hot_stages([f"{c}__str" for c in categorical], categorical)
    stages.append(
        VectorAssembler(
            inputCols=[f"{c}__num" for c in numeric] + [f"{c}__hot" for c in categorical],
            outputCol=out, handleInvalid="error",
        )
    )
    model = Pipeline(stages=stages).fit(train)
    names = [f"num__{c}" for c in numeric]
    names += [f"cat__{c}_{v}" for c, vs in zip(categorical, one_hot_labels(model)) for v in vs]
    return model, names


def transform_features(model: PipelineModel, df: DataFrame, out: str = "features") -> DataFrame:
    """Apply a preprocessor and keep the input columns and the vector only."""
    return model.transform(df).select(*[col(c) for c in df.columns], out)

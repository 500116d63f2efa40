"""Which analysis a table calls for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.columns import col
from dataquarry.operators.profile import FREE_TEXT, infer_semantic_type

# Route names.
SUPERVISED, UNSUPERVISED, TEXT = "fase_1", "fase_2", "fase_3"
CLASS_LIMIT = 15


def route_decision(df: DataFrame, target: str | None = None, assume_last: bool = False) -> DataFrame:
    """``(route, target, reason)``, one row, from the column types."""
    if target is None and assume_last:
        target = df.columns[-1]
    if target is not None and target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    types = infer_semantic_type(df)
    if target is not None:
        is_text = F.max(F.when(F.col("column") == target, F.col("tipo") == FREE_TEXT))
        route = F.when(is_text, TEXT).otherwise(SUPERVISED)
        reason = F.when(is_text, "free-text target").otherwise("structured target")
    else:
        mostly = F.avg((F.col("tipo") == FREE_TEXT).cast("int")) > 0.5
        route = F.when(mostly, TEXT).otherwise(UNSUPERVISED)
        reason = F.when(mostly, "mostly free text").otherwise("no target, structured columns")
    return types.agg(route.alias("route"), F.lit(target or "").alias("target"), reason.alias("reason"))


def infer_task_type(df: DataFrame, target: str) -> DataFrame:
    """``(target, cardinality, task)``: under 15 distinct values is a classification."""
    if target not in df.columns:
        n = F.lit(None).cast("bigint")
        return df.sparkSession.range(1).select(
            F.lit(target).alias("target"), n.alias("cardinality"), F.lit("classification").alias("task")
        )
    n = F.count_distinct(col(target))
    return df.agg(
        F.lit(target).alias("target"),
        n.alias("cardinality"),
        F.when(n < CLASS_LIMIT, "classification").otherwise("regression").alias("task"),
    )


def first_free_text_column(types: DataFrame) -> DataFrame:
    """``(column)``: the first free-text column of a profile, else the first column."""
    order = F.struct((F.col("tipo") != FREE_TEXT).alias("no"), F.col("ordinal"))
    return types.agg(F.min_by("column", order).alias("column"))

"""Phase checkpoints (table and metadata) and fitted models on shared storage."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.sources.tables import path_size


def phase_name(phase: str) -> str:
    return phase.strip().replace(" ", "_").lower()


def checkpoint_folder(root: str, run: str, phase: str) -> str:
    if not run.strip() or not phase.strip():
        raise ValueError("run id and phase must not be empty")
    return f"{root.rstrip('/')}/{run.strip()}/{phase_name(phase)}"


def checkpoint_write(df: DataFrame, root: str, run: str, phase: str, metadata: dict | None = None) -> tuple[str, str]:
    """Write a phase's table as Parquet and its metadata (null without any) as JSON; returns both paths."""
    folder = checkpoint_folder(root, run, phase)
    df.write.mode("overwrite").parquet(f"{folder}/data")
    text = json.dumps(metadata, ensure_ascii=False)
    spark = df.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return f"{folder}/data", f"{folder}/metadata"


def checkpoint_read(spark: SparkSession, root: str, run: str, phase: str) -> tuple[DataFrame | None, dict | None]:
    """``(table, metadata)`` of a phase; ``(None, None)`` when it was never written."""
    folder = checkpoint_folder(root, run, phase)
    if not path_size(spark, f"{folder}/data")[0]:
        return None, None
    metadata = None
    if path_size(spark, f"{folder}/metadata")[0]:
        lines = [r["value"] for r in spark.read.option("wholetext", True).text(f"{folder}/metadata").collect()]
        metadata = json.loads("".join(lines) or "null")
    return spark.read.parquet(f"{folder}/data"), metadata


def write_metadata(profile: DataFrame, path: str) -> None:
    """A profile table as JSON lines, one document per column."""
    profile.select(F.to_json(F.struct(*profile.columns)).alias("value")).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", ddl).alias("m")).select("m.*")


def model_save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def model_load(path: str) -> PipelineModel:
    return PipelineModel.load(path)

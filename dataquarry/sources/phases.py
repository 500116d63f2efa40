"""Phases of an analysis that are published once and read back when a run is repeated.

A run lives in a folder named after the digest of its input and options, so what another
input or another option gave is never taken.  A phase writes its tables and models and at
last its manifest; a phase without a manifest was interrupted and is built again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dataquarry.runtime import new_path, scratch, write_table
from dataquarry.sources.checkpoints import checkpoint_folder, model_load, model_save
from dataquarry.sources.tables import path_size

Part = DataFrame | PipelineModel | None


def table_digest(df: DataFrame) -> str:
    """A digest of schema and rows that depends on neither order nor partitions: one pass, no shuffle of rows."""
    cells = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    # Nulls do not change a hash, so where they stand is hashed as well.
    nulls = F.concat_ws("", F.lit(""), *[c.isNull().cast("string") for c in cells])
    row = F.xxhash64(*cells, nulls)
    found = df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"),
        F.bit_xor(F.hash("h")).alias("xor"),
    ).first()
    return hashlib.sha256(f"{df.schema.json()}|{found['n']}|{found['sum']}|{found['xor']}".encode()).hexdigest()


class Phases:
    """Steps whose results are written as intermediate tables and not kept for another run."""

    def step(self, phase: str, build: Callable[[], dict[str, Part]]) -> dict[str, Part]:
        """The parts that ``build`` returns: tables, fitted pipelines, or None.  Intermediate tables of the step are removed."""
        spark = SparkSession.active()
        folder, found = new_path(spark, phase), {}
        with scratch(spark):
            for name, part in build().items():
                found[name] = write_table(part, f"{folder}-{name}") if isinstance(part, DataFrame) else part
        return found


class SavedPhases(Phases):
    """Steps that are published under ``root`` and read back if the same run has published them.

    ``df`` and ``options`` identify the run, in addition to its name.  Intermediate tables
    of a step are removed once it is published.
    """

    def __init__(self, df: DataFrame, root: str, run: str, **options):
        self.spark: SparkSession = df.sparkSession
        self.root = root
        told = json.dumps(options, sort_keys=True, default=str)
        self.run = f"{run.strip()}-{hashlib.sha256(f'{table_digest(df)}|{told}'.encode()).hexdigest()[:16]}"

    def _manifest(self, folder: str) -> dict | None:
        if not path_size(self.spark, f"{folder}/manifest")[1]:
            return None
        lines = [r["value"] for r in self.spark.read.text(f"{folder}/manifest").collect()]
        return json.loads(lines[0]) if lines else None

    def done(self, phase: str) -> bool:
        return self._manifest(checkpoint_folder(self.root, self.run, phase)) is not None

    def step(self, phase: str, build: Callable[[], dict[str, Part]]) -> dict[str, Part]:
        folder = checkpoint_folder(self.root, self.run, phase)
        manifest = self._manifest(folder)
        if manifest is None:
            manifest = {}
            with scratch(self.spark):
                for name, part in build().items():
                    manifest[name] = None
                    if isinstance(part, DataFrame):
                        write_table(part, f"{folder}/{name}", "overwrite")
                        manifest[name] = part.schema.jsonValue()
                    elif part is not None:
                        model_save(part, f"{folder}/{name}")
                        manifest[name] = "model"
                line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
                line.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return {name: self._read(f"{folder}/{name}", kind) for name, kind in manifest.items()}

    def _read(self, path: str, kind: dict | str | None) -> Part:
        if kind is None:
            return None
        if kind == "model":
            return model_load(path)
        return self.spark.read.schema(StructType.fromJson(kind)).parquet(path)

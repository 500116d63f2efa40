"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_float(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means null: replace NaN in FLOAT/DOUBLE columns, leave the rest untouched."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(c), c).alias(n) if n in floats else c.alias(n)
            for n in df.columns
            for c in [F.col(f"`{n}`")]
        ]
    )


def metadata_json(*cols: Column) -> Column:
    """Nested metadata of a row as one JSON string."""
    return F.to_json(F.struct(*cols))


def parse_metadata(text: Column, ddl: str) -> Column:
    return F.from_json(text, ddl)

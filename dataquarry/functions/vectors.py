"""Vector columns: ARRAY<FLOAT/DOUBLE> in, JVM expressions only."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = "array<double>"


def as_array(df: DataFrame, col: str) -> Column:
    """``col`` as ARRAY<DOUBLE> whether it holds ML vectors or arrays."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast(_DOUBLES)
    return vector_to_array(F.col(col))


def as_vector(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return array_to_vector(F.col(col).cast(_DOUBLES))
    return F.col(col)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is evaluated again for every element; a lambda
    variable is not.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast(_DOUBLES), b.cast(_DOUBLES), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast(_DOUBLES), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either is the zero vector."""
    return let(norm(a) * norm(b), lambda size: F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return let(
        a.cast(_DOUBLES),
        lambda v: let(norm(v), lambda size: F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size))),
    )


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))

"""Dropping sparse columns, imputation, and per-column cleaning plans."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.operators.columns import col, is_number
from dataquarry.operators.ordered import quantiles_of
from dataquarry.operators.profile import profile_categorical

log = logging.getLogger(__name__)

MAX_MISSING = 0.60
NO_MODE = "MISSING"


def null_fractions(df: DataFrame) -> dict[str, float | None]:
    """Share of nulls of every column, one pass; None for an empty table."""
    if not df.columns:
        return {}
    row = df.agg(*[F.avg(col(c).isNull().cast("int")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return {c: row[i] for i, c in enumerate(df.columns)}


def drop_high_missing(df: DataFrame, threshold: float = MAX_MISSING, fractions: dict | None = None) -> DataFrame:
    """Drop the columns whose null share is strictly above ``threshold``."""
    fractions = null_fractions(df) if fractions is None else fractions
    gone = [c for c in df.columns if fractions[c] is not None and fractions[c] > threshold]
    return df.drop(*gone)


def fill_values(df: DataFrame, medians: Iterable[str] = (), modes: Iterable[str] = ()) -> dict[str, object]:
    """Median or mode of the named columns; None where a column has no value at all."""
    medians, modes = list(medians), list(modes)
    fills: dict[str, object] = {c: q[0] for c, q in quantiles_of(df, medians, [0.5]).items()}
    if modes:
        found = {r["column"]: r["mode"] for r in profile_categorical(df, modes).collect()}
        fills.update({c: found.get(c) for c in modes})
    return fills


def fill_nulls(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Replace nulls by the given values in one projection.

    An integral column takes a fractional median as DOUBLE; a column of another
    type than string gets its mode cast back to that type.
    """
    out = []
    for f in df.schema:
        value, c = fills.get(f.name), col(f.name)
        if value is None:
            out.append(c)
        elif is_number(f):
            whole = isinstance(f.dataType, T.IntegralType) and float(value).is_integer()
            kind = f.dataType if whole or not isinstance(f.dataType, T.IntegralType) else T.DoubleType()
            out.append(F.coalesce(c.cast(kind), F.lit(value).cast(kind)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(value).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def _fills_for(df: DataFrame, medians: list[str], modes: list[str]) -> dict[str, object]:
    fills = fill_values(df, medians, modes)
    for c in modes:
        if fills[c] is None and isinstance(df.schema[c].dataType, T.StringType):
            fills[c] = NO_MODE
    return fills


def impute_missing(df: DataFrame, fractions: dict | None = None) -> DataFrame:
    """Numeric columns get their median, the others their mode (``MISSING`` without one).

    Only columns that hold nulls are looked at.
    """
    fractions = null_fractions(df) if fractions is None else fractions
    holed = [f for f in df.schema if fractions.get(f.name)]
    if not holed:
        return df
    medians = [f.name for f in holed if is_number(f)]
    modes = [f.name for f in holed if not is_number(f)]
    return fill_nulls(df, _fills_for(df, medians, modes))


def clean_table(df: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """Drop sparse columns, then impute; the null shares are computed once."""
    fractions = null_fractions(df)
    return impute_missing(drop_high_missing(df, max_missing, fractions), fractions)


def apply_cleaning_plan(df: DataFrame, plan: Iterable[tuple[str, str]]) -> DataFrame:
    """Apply ``(column, action)`` pairs: drop, impute_median, impute_mode, keep, scale, encode.

    Unknown columns and actions are skipped with a warning; drops come last.
    ``scale`` and ``encode`` are left to the feature operators.
    """
    gone, medians, modes = [], [], []
    for name, action in plan:
        action = action.lower().strip()
        if name not in df.columns:
            log.warning("cleaning plan: no column %s", name)
        elif action == "drop":
            gone.append(name)
        elif action == "impute_median":
            medians.append(name)
        elif action == "impute_mode":
            modes.append(name)
        elif action not in {"keep", "scale", "encode"}:
            log.warning("cleaning plan: unknown action %s for %s", action, name)
    medians = [c for c in dict.fromkeys(medians) if c not in gone]
    modes = [c for c in dict.fromkeys(modes) if c not in gone and c not in medians]
    if medians or modes:
        df = fill_nulls(df, _fills_for(df, medians, modes))
    return df.drop(*gone)

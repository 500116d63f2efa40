"""Column profiles: nulls, distinct counts, moments, modes, semantic types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.functions.hashing import value_key
from dataquarry.functions.scalars import safe_float
from dataquarry.operators.columns import categorical_columns, col, is_number, mapping, numeric_columns
from dataquarry.runtime import materialise

# Names of the semantic types, and the mean length above which a
# string column is free text.  A missing value counts as a text of 3 characters.
NUMERIC, CATEGORICAL, FREE_TEXT = "Numérico", "Categórico", "Texto Libre"
FREE_TEXT_LENGTH = 50
NULL_TEXT_LENGTH = 3


def corrected_skewness(x: Column) -> Column:
    """Sample skewness with bias correction; null under 3 values or for a constant."""
    n = F.count(x).cast("double")
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return safe_float(F.when((F.count(x) >= 3), g))


def corrected_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis with bias correction; null under 4 values or for a constant."""
    n = F.count(x).cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return safe_float(F.when((F.count(x) >= 4), g))


def numeric_stats(x: Column) -> list[Column]:
    x = x.cast("double")
    return [
        safe_float(F.avg(x)).alias("mean"),
        safe_float(F.stddev_samp(x)).alias("std"),
        corrected_skewness(x).alias("skewness"),
        corrected_kurtosis(x).alias("kurtosis"),
    ]


def _plain(df: DataFrame, c: str) -> Column:
    """Booleans as 0/1, everything else as it is."""
    return col(c).cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else col(c)


def column_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form ``(ordinal, column, is_numeric, x, len, present)``, one row per cell.

    Few aggregates over a narrow long table stay inside generated code; the same
    statistics as one wide aggregate would leave it after a hundred buffer fields.
    """
    cells = []
    for c in columns:
        kind = df.schema[c].dataType
        numeric = is_number(df.schema[c], booleans=True)
        is_string = isinstance(kind, T.StringType)
        cells.append(
            F.struct(
                F.lit(df.columns.index(c) + 1).alias("ordinal"),
                F.lit(c).alias("column"),
                F.lit(numeric).alias("is_numeric"),
                (_plain(df, c) if numeric else F.lit(None)).cast("double").alias("x"),
                (F.length(col(c)) if is_string else F.lit(None)).cast("int").alias("len"),
                F.lit(is_string).alias("is_string"),
                col(c).isNotNull().alias("present"),
            )
        )
    return df.select(F.inline(F.array(*cells)))


def profile_numeric(df: DataFrame) -> DataFrame:
    """``(column, mean, std, skewness, kurtosis)`` of every numeric column, one pass."""
    cells = column_rows(df, numeric_columns(df, booleans=True))
    return cells.groupBy("column").agg(*numeric_stats(F.col("x")))


def _mean_length(null_length: int | None = NULL_TEXT_LENGTH) -> Column:
    size = F.col("len") if null_length is None else F.coalesce("len", F.lit(null_length))
    return F.avg(F.when(F.col("is_string"), size))


def _tipo(mean_length: Column) -> Column:
    return (
        F.when(F.col("is_numeric"), NUMERIC)
        .when(mean_length > FREE_TEXT_LENGTH, FREE_TEXT)
        .otherwise(CATEGORICAL)
    )


def infer_semantic_type(df: DataFrame, null_length: int | None = NULL_TEXT_LENGTH) -> DataFrame:
    """``(ordinal, column, tipo)``; strings are told apart by their mean length.

    Only string columns are read: the type decides about all others.
    """
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    fixed = df.sparkSession.createDataFrame(
        [
            (i, f.name, NUMERIC if is_number(f, booleans=True) else CATEGORICAL)
            for i, f in enumerate(df.schema, 1)
            if f.name not in strings
        ],
        "ordinal int, column string, tipo string",
    )
    if not strings:
        return fixed
    lengths = (
        column_rows(df, strings)
        .groupBy("ordinal", "column", "is_numeric")
        .agg(_mean_length(null_length).alias("mean_length"))
        .select("ordinal", "column", _tipo(F.col("mean_length")).alias("tipo"))
    )
    seen = df.sparkSession.createDataFrame(
        [(df.columns.index(c) + 1, c) for c in strings], "ordinal int, column string"
    )
    # An empty table has no rows to measure: its strings are categorical.
    texts = seen.join(lengths.select("column", "tipo"), "column", "left").select(
        "ordinal", "column", F.coalesce("tipo", F.lit(CATEGORICAL)).alias("tipo")
    )
    return fixed.unionByName(texts)


def semantic_types(df: DataFrame, null_length: int | None = NULL_TEXT_LENGTH) -> dict[str, str]:
    return {r["column"]: r["tipo"] for r in infer_semantic_type(df, null_length).collect()}


def _value_family(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType | T.IntegralType):
        return "bigint"
    if isinstance(field.dataType, T.FloatType | T.DoubleType):
        return "double"
    return "string"


# Characters of a value that travel with its key when the mode is looked for.
HEAD_CHARS = 64


def value_counts(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    """``(column, value, n)`` for columns of one value family; combined map-side.

    Long form instead of many ``count(distinct)``: those would multiply every row
    by the number of columns *and* shuffle all of them.  Long texts are counted by their digest.
    """
    value = lambda c: (F.col(f"`{c}`").cast("double") + 0.0) if family == "double" else F.col(f"`{c}`").cast(family)
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]))
    )
    pairs = pairs.filter("value is not null")
    if family == "string":
        pairs = pairs.withColumn("value", value_key(F.col("value")))
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _cardinality(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    return value_counts(df, columns, family).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))


def _most_frequent(df: DataFrame, heads: dict[str, str], size: int) -> DataFrame:
    """``(column, cardinality, head, mode_count)`` of the values that begin with the column's head.

    ``head`` is the first ``size`` characters of the smallest of the most frequent values.
    Values are counted by their keys; no more than their first characters travel with them.
    """
    cells = []
    for c, head in heads.items():
        value = F.col(f"`{c}`").cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), (F.when(value.startswith(head), value) if head else value).alias("value")))
    counts = (
        df.select(F.inline(F.array(*cells)))
        .filter("value is not null")
        .groupBy("column", value_key(F.col("value")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.substring("value", 1, size)).alias("head"))
    )
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("head")))
    return (
        counts.groupBy("column")
        .agg(F.count(F.lit(1)).alias("cardinality"), top.alias("top"))
        .select("column", "cardinality", F.col("top.head").alias("head"), (-F.col("top.neg")).alias("mode_count"))
    )


def profile_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, cardinality, mode, mode_count)``; the smallest of equally frequent values.

    A mode that is longer than its head is completed in further passes: each takes the
    values that begin with the head found so far, and a head sixteen times as long.
    """
    columns = categorical_columns(df, booleans=False) if columns is None else columns
    kind = "column string, cardinality bigint, mode string, mode_count bigint"
    size, heads = HEAD_CHARS, dict.fromkeys(columns, "")
    seen: dict[str, tuple] = {}
    while heads:
        found = {r["column"]: r for r in _most_frequent(df, heads, size).collect()}
        # Among values with one head, the most frequent ones are as frequent as before.
        for c, r in found.items():
            first = seen.get(c, (c, r["cardinality"], None, r["mode_count"]))
            seen[c] = (c, first[1], r["head"], first[3])
        heads = {c: r["head"] for c, r in found.items() if len(r["head"]) >= size}
        size *= 16
    return df.sparkSession.createDataFrame([seen[c] for c in columns if c in seen], kind)


def profile_long_text(df: DataFrame, c: str) -> DataFrame:
    """The same row for a free-text column, shuffling digests instead of texts.

    Whole texts are read again only to find the smallest of the most frequent ones.
    """
    text = df.select(col(c).cast("string").alias("value")).filter("value is not null")
    counts = materialise(
        text.groupBy(F.sha2("value", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n")), "digests"
    )
    seen = counts.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m")).first()
    if seen["m"] is not None and seen["m"] > 1:
        top = counts.filter(F.col("n") == seen["m"]).select("digest")
        text = text.withColumn("digest", F.sha2("value", 256)).join(top, "digest", "left_semi")
    return text.agg(
        F.lit(c).alias("column"),
        F.lit(seen["k"]).cast("bigint").alias("cardinality"),
        F.min("value").alias("mode"),
        F.lit(seen["m"]).cast("bigint").alias("mode_count"),
    )


def _pct(nulls: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * nulls / total, 4))


def _with_all_columns(df: DataFrame, scan: DataFrame) -> DataFrame:
    """An empty table yields no long rows; every column still gets its profile row."""
    names = mapping(df)
    numeric = set(numeric_columns(df, booleans=True))
    base = df.sparkSession.createDataFrame(
        [(i, c, names[c], c in numeric) for i, c in enumerate(df.columns, 1)],
        "ordinal int, column string, masked string, is_numeric boolean",
    )
    return base.join(scan, "column", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("total", "nulls")}
    )


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if(~F.col("present")).alias("nulls")]


def profile_nulls(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``(column, total, nulls, pct_nulls, cardinality)``; distinct counts exact by default."""
    scan = column_rows(df, df.columns).groupBy("column").agg(*_counts())
    scan = _with_all_columns(df, scan)
    if approximate:
        wide = df.agg(*[
            F.struct(F.lit(c).alias("column"), F.approx_count_distinct(col(c)).alias("cardinality")).alias(f"s{i}")
            for i, c in enumerate(df.columns)
        ])
        distinct = wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(df.columns))])))
    else:
        distinct = _cardinalities(df, df.columns)
    return scan.join(distinct, "column", "left").select(
        "column", "total", "nulls", _pct(F.col("nulls"), F.col("total")).alias("pct_nulls"),
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
    )


def _cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_value_family(df.schema[c]), []).append(c)
    out = None
    for family, names in families.items():
        # Distinct strings travel as digests; they may be whole documents.
        source = df.select(*[F.sha2(col(c).cast("string"), 256).alias(c) for c in names]) if family == "string" else df
        part = _cardinality(source, names, family)
        out = part if out is None else out.unionByName(part)
    return out


PROFILE_COLUMNS = [
    "ordinal", "column", "masked", "tipo", "total", "nulls", "pct_nulls", "cardinality",
    "mean", "std", "skewness", "kurtosis", "mode", "mode_count",
]


def profile_table(df: DataFrame, redact_values: bool = False) -> DataFrame:
    """The full profile, one row per column.

    One scan counts, measures and takes the moments of all columns together, one
    counts values.  Free text takes an extra scan of its own column.
    """
    numeric = numeric_columns(df, booleans=True)
    scan = column_rows(df, df.columns).groupBy("column").agg(
        *_counts(), _mean_length().alias("mean_length"),
        *numeric_stats(F.col("x")),
    )
    others = categorical_columns(df, booleans=False)
    kinds = semantic_types(df.select(*others)) if others else {}
    texts = [c for c in others if kinds[c] == FREE_TEXT]
    plain = [c for c in others if c not in texts]

    parts = []
    if numeric:
        empty = [F.lit(None).cast("string").alias("mode"), F.lit(None).cast("bigint").alias("mode_count")]
        parts.append(_cardinalities(df, numeric).select("column", "cardinality", *empty))
    if plain:
        parts.append(profile_categorical(df, plain))
    parts += [profile_long_text(df, c) for c in texts]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)

    out = (
        _with_all_columns(df, scan)
        .withColumn("tipo", _tipo(F.col("mean_length")))
        .withColumn("pct_nulls", _pct(F.col("nulls"), F.col("total")))
        .join(values, "column", "left")
        .withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    )
    if redact_values:
        out = out.withColumn("mode", F.lit(None).cast("string"))
    return out.select(*PROFILE_COLUMNS)


def profile_json(profile: DataFrame) -> DataFrame:
    """One JSON document per profiled column: ``(column, metadata)``."""
    return profile.select("column", F.to_json(F.struct(*profile.columns)).alias("metadata"))

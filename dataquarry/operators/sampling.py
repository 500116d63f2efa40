"""Reproducible splits, folds and samples: the hash of a key decides, not the row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquarry.functions.hashing import key_hash, salted_digest
from dataquarry.operators.ordered import rank_cuts

TEST_SHARE = 0.20
FOLDS = 5


def _reached(name: str, cut: Column) -> Column:
    """Whether the row's (hash, key) is at or before a cut; no cut means no."""
    h, k = F.col("_h"), F.col(name)
    return F.coalesce((h < cut["h"]) | ((h == cut["h"]) & (k <= cut["k"])), F.lit(False))


def train_test_split(
    df: DataFrame, key: str, target: str | None = None, test_share: float = TEST_SHARE, salt: str = "split"
) -> DataFrame:
    """Add BOOLEAN ``is_test``.

    With a target the split is exact within each class: the first
    ``round(test_share * n)`` rows of the class in hash order are the test rows (a
    class of one row stays in training).  Without, a hash bucket decides, and no
    shuffle is needed.
    """
    if target is None:
        share = F.lit(int(round(test_share * 10_000)))
        return df.withColumn("is_test", key_hash(F.col(key), salt) % 10_000 < share)
    rank = F.floor(F.lit(test_share) * F.col("n") + 0.5)
    cuts = rank_cuts(df, key, [target], [rank], salt)
    hashed = df.withColumn("_h", key_hash(F.col(key), salt))
    return _join_cuts(hashed, cuts, target).withColumn(
        "is_test", _reached(key, F.element_at("_cuts", F.lit(0)))
    ).drop("_h", "_cuts")


def _join_cuts(df: DataFrame, cuts: DataFrame, target: str) -> DataFrame:
    # One row per class, read from a written table: broadcast by its known size.
    right = cuts.select(F.col(target).alias("_class"), F.col("cuts").alias("_cuts"))
    return df.join(right, df[target].eqNullSafe(right["_class"]), "left").drop("_class")


def kfold_assign(
    df: DataFrame, key: str, target: str | None = None, folds: int = FOLDS, salt: str = "fold"
) -> DataFrame:
    """Add INT ``fold`` in ``0..folds-1``; equal shares of every class with a target.

    The salt differs from the split's: with the same hash, folds would nest in it.
    """
    if target is None:
        return df.withColumn("fold", (key_hash(F.col(key), salt) % folds).cast("int"))
    ranks = [F.floor(F.col("n") * j / folds) for j in range(1, folds)]
    cuts = rank_cuts(df, key, [target], ranks, salt)
    hashed = df.withColumn("_h", key_hash(F.col(key), salt))
    # A row lies after every cut it has not reached; a rank of 0 makes no cut and is passed.
    passed = [(~_reached(key, F.element_at("_cuts", F.lit(j)))).cast("int") for j in range(folds - 1)]
    return _join_cuts(hashed, cuts, target).withColumn("fold", sum(passed[1:], passed[0])).drop("_h", "_cuts")


def sample_rows(df: DataFrame, key: str, n: int = 100, salt: str = "42") -> DataFrame:
    """``n`` rows in hash order: a distributed top-n, no sort of the table."""
    digest = salted_digest(F.col(key), salt)
    return df.withColumn("_d", digest).orderBy("_d", key).limit(n).drop("_d")


def sample_per_group(
    df: DataFrame, by: Sequence[str], key: str, n: int = 3, not_null: str | None = None, salt: str = "42"
) -> DataFrame:
    """At most ``n`` rows of every group in hash order, with their ``rank``.

    Spark cuts each group to ``n`` rows on the map side before the shuffle, so a
    group holding most of the table costs no more than any other.
    """
    if not_null is not None:
        df = df.filter(F.col(not_null).isNotNull())
    order = Window.partitionBy(*by).orderBy("_d", key)
    ranked = df.withColumn("_d", salted_digest(F.col(key), salt)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).drop("_d")

"""Exact classification, regression and cross-validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquarry.operators.ordered import quantiles_of, running_totals
from dataquarry.operators.profile import profile_categorical


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``(y, pred, n)``: counts by actual and predicted class."""
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``(accuracy, precision, recall, f1)``, weighted by class share; an empty precision is 0."""
    cells = confusion_matrix(df, y, pred)
    per = (
        cells.select(
            F.inline(F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("tp")),
            ))
        )
        .groupBy("c")
        .agg(F.sum("support").alias("s"), F.sum("predicted").alias("p"), F.sum("tp").alias("tp"))
    )
    total = F.sum("s")
    precision = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)
    recall = F.when(F.col("s") > 0, F.col("tp") / F.col("s")).otherwise(0.0)
    f1 = 2.0 * F.col("tp") / (F.col("s") + F.col("p"))
    return per.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("s") * precision) / total).alias("precision"),
        (F.sum(F.col("s") * recall) / total).alias("recall"),
        (F.sum(F.col("s") * f1) / total).alias("f1"),
    )


def roc_auc(df: DataFrame, y: str, score: str, positive: object = 1) -> DataFrame:
    """``(positives, negatives, auc)``: exact, ties counted half.

    Rows collapse to distinct scores first; the running count of lower negatives is
    taken over range-partitioned scores, never in one task.
    """
    is_pos = (F.col(y) == F.lit(positive)).cast("int")
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg"))
    )
    counted = running_totals(per_score, ["s"], {"below": "neg"}, "auc")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return counted.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), wins.alias("wins")
    ).select(
        "positives", "negatives",
        F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / F.col("positives") / F.col("negatives")).alias("auc"),
    )


def roc_auc_weighted(df: DataFrame, y: str, probabilities: str, classes: list) -> DataFrame:
    """One-vs-rest AUC of each class, weighted by class share, in one pass; ``probabilities`` is an array in class order."""
    per_score = (
        df.filter(F.col(y).isNotNull())
        .select(F.col(y).alias("y"), F.posexplode(F.slice(F.col(probabilities), 1, len(classes))).alias("i", "s"))
        .filter("s is not null")
        .select("i", F.col("s").cast("double").alias("s"), (F.col("y") == F.get(F.array(*[F.lit(c) for c in classes]), F.col("i"))).cast("int").alias("p"))
        .groupBy("i", "s")
        .agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    )
    # One running count over (class, score); what earlier classes add is its least value in the class.
    counted = running_totals(per_score, ["i", "s"], {"below": "neg"}, "auc")
    per_class = counted.groupBy("i").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("below").alias("before"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"),
    )
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("wins") - F.col("before") * F.col("p")) / F.col("p") / F.col("n"))
    return per_class.select("p", auc.alias("auc")).agg((F.sum(F.col("auc") * F.col("p")) / F.sum("p")).alias("auc"))


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """``(rmse, r2)``."""
    y_, p_ = F.col(y).cast("double"), F.col(pred).cast("double")
    both = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    err = y_ - p_
    return both.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(F.var_pop(y_) > 0, 1 - F.avg(err * err) / F.var_pop(y_)).alias("r2"),
    )


def baseline_predictor(train: DataFrame, test: DataFrame, target: str, task: str) -> DataFrame:
    """Predict the most frequent class, or the median, of the training target."""
    if task == "classification":
        mode = profile_categorical(train.select(target), [target]).first()
        value = F.lit(mode["mode"] if mode else None).cast(train.schema[target].dataType)
    else:
        value = F.lit(quantiles_of(train, [target], [0.5])[target][0]).cast("double")
    return test.withColumn("prediction", value)


def cv_summary(scores: DataFrame) -> DataFrame:
    """``(model, mean, std)`` of fold scores; population standard deviation."""
    return scores.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def top_k_importance(table: DataFrame, value: str, k: int = 5, name: str = "feature") -> DataFrame:
    """The ``k`` features with the largest value."""
    return table.orderBy(F.desc(value), name).limit(k)

"""Scores of predictions by dataset, as aggregations. predictions: dataset, y_true, y_pred, proba."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.operators.ranking import running_before
from tabmill.sources.storage import written


def positive_score(proba: Column) -> Column:
    """The positive class's probability of a two-class prediction; null for others."""
    return F.when(F.size(proba) == 2, F.get(proba, F.lit(1)))


def roc_auc(scored: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """keys, roc_auc: ties count half; null if only one class occurs. positive: a boolean column.

    Rows are collapsed to distinct scores, so ties are together, and negatives below each are totalled by ranges of scores: no
    task sorts a dataset.
    """
    by = scored.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    by = running_before(written(by, "scores"), keys, score, "n", "_below")
    by = by.withColumn("won", F.col("p") * (F.col("_below") + F.col("n") / 2))
    return by.groupBy(*keys).agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("roc_auc"))


def roc_auc_macro(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roc_auc: each class against the rest, then their mean; classes that don't occur, or alone do, have no score."""
    by = predictions.select(*keys, "y_true", F.posexplode("proba").alias("_class", "score"))
    by = by.withColumn("positive", F.col("y_true") == F.col("_class"))
    return roc_auc(by, [*keys, "_class"]).groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc"))


def accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    by = predictions.groupBy(*keys, "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return by.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def r2(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r2; of a constant target 1 if all is predicted exactly, else 0."""
    mean = predictions.groupBy(*keys).agg(F.avg("y_true").alias("_mean"))
    d = predictions.join(mean, keys)
    by = d.groupBy(*keys).agg(F.sum(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("left"), F.sum(F.pow(F.col("y_true") - F.col("_mean"), 2)).alias("all"))
    return by.select(*keys, F.when(F.col("all") > 0, 1 - F.col("left") / F.nullif(F.col("all"), F.lit(0.0))).otherwise((F.col("left") == 0).cast("double")).alias("r2"))


def long_form(scores: DataFrame, keys: list[str], name: str) -> DataFrame:
    return scores.select(*keys, F.lit(name).alias("metric"), F.col(name).alias("value"))


def with_average(metrics: DataFrame) -> DataFrame:
    """dataset, metric, value with one more row per metric: the mean over datasets, under the dataset 'average'."""
    mean = metrics.groupBy("metric").agg(F.avg("value").alias("value"))
    return metrics.select("dataset", "metric", "value").unionByName(mean.select(F.lit("average").alias("dataset"), "metric", "value"))

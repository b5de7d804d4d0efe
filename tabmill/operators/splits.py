"""Splits of rows, and filters of tasks by what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.functions.numbers import uniform


def split_by_list(table: DataFrame, splits: DataFrame, task_id: int, fold: int = 0, repeat: int = 0) -> DataFrame:
    """table's rows with is_context, by listed splits. splits: task_id, fold, repeat, row_id, is_train."""
    own = splits.where((F.col("task_id") == task_id) & (F.col("fold") == fold) & (F.col("repeat") == repeat))
    return table.join(own.select("row_id", F.col("is_train").alias("is_context")), "row_id")


def one_side(table: DataFrame, splits: DataFrame, task_id: int, train: bool, fold: int = 0, repeat: int = 0) -> DataFrame:
    own = splits.where((F.col("task_id") == task_id) & (F.col("fold") == fold) & (F.col("repeat") == repeat) & (F.col("is_train") == train))
    return table.join(own, "row_id", "left_semi")


def join_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sides' rows with is_context; a column that one side lacks is null there."""
    return train.withColumn("is_context", F.lit(True)).unionByName(test.withColumn("is_context", F.lit(False)), allowMissingColumns=True)


def of_type(tasks: DataFrame, classification: bool) -> DataFrame:
    return tasks.where(F.col("task_type") == ("classification" if classification else "regression"))


def small_enough(tasks: DataFrame, max_n_features: int = 500, max_n_samples: int = 10_000) -> DataFrame:
    """Tasks within both limits; decided on the tasks' facts, before any table is read."""
    return tasks.where((F.col("n_features") <= max_n_features) & (F.col("n_samples") <= max_n_samples))


def chosen_folds(splits: DataFrame, folds: int = 1, repeat: int = 0) -> DataFrame:
    return splits.where((F.col("fold") < folds) & (F.col("repeat") == repeat))


def random_split(row_id: Column, seed: int = 42, train_share: float = 0.5) -> Column:
    """True for training rows. The same for an id under any partitioning."""
    return uniform(F.lit(seed), row_id) < train_share

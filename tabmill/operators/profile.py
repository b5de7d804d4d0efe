"""What a collection holds: shapes, target ranges, classes, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_summary(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: n_tables, n_rows, max_rows, max_features, min_split, max_split."""
    return datasets.agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("max_rows"), F.max("n_features").alias("max_features"), F.min("split_index").alias("min_split"), F.max("split_index").alias("max_split"))


def target_range(rows: DataFrame) -> DataFrame:
    """dataset_id (null for all), y_min, y_max."""
    return rows.rollup("dataset_id").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def class_distribution(rows: DataFrame) -> DataFrame:
    """y, n, percent of all rows."""
    by = rows.groupBy("y").agg(F.count("*").alias("n"))
    all_rows = by.agg(F.sum("n").alias("_all"))
    return by.select("y", "n", (100.0 * F.col("n") / all_rows.scalar()).alias("percent"))


def class_centroids(rows: DataFrame) -> DataFrame:
    """dataset_id, y, n, x0_mean, x1_mean."""
    x = lambda k: F.avg(F.get("x", F.lit(k)))
    return rows.groupBy("dataset_id", "y").agg(F.count("*").alias("n"), x(0).alias("x0_mean"), x(1).alias("x1_mean"))


def classes_per_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset_id").agg(F.count_distinct("y").alias("n_classes"))

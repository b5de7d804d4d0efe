"""Batch plans over a collection of tables, and what is aggregated or dropped by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_plan(spark: SparkSession, n_tables: int, batch_size: int, num_steps: int, epochs: int = 1, start: int = 0) -> DataFrame:
    """batch_no, epoch, step, dataset_pos: the tables of each batch.

    Batches follow the stored order. When one reaches the end, the next starts again at the first table, so the batch before
    may be short. The place is kept from epoch to epoch. start: the first batch's first table, a place below n_tables.
    """
    if batch_size < 1 or num_steps < 0 or epochs < 0:
        raise ValueError("batch_size must be at least 1, num_steps and epochs at least 0")
    if n_tables and not 0 <= start < n_tables:
        raise ValueError(f"start must be a place below {n_tables}")
    if not n_tables:
        return spark.createDataFrame([], "batch_no long, epoch long, step long, dataset_pos long")
    first = -(-(n_tables - start) // batch_size)
    each = -(-n_tables // batch_size)
    no = F.col("batch_no")
    at = F.when(no < first, start + no * batch_size).otherwise((no - first) % each * batch_size)
    plan = spark.range(epochs * num_steps).withColumnRenamed("id", "batch_no")
    plan = plan.withColumn("epoch", F.floor(no / num_steps)).withColumn("step", no % num_steps)
    return plan.select("*", F.explode(F.sequence(at, F.least(at + batch_size, F.lit(n_tables)) - 1)).alias("dataset_pos"))


def plan_ranges(n_tables: int, batch_size: int, num_steps: int, epochs: int = 1, start: int = 0) -> list[tuple[int, int]]:
    """The places that a batch_plan() of these numbers reads, as at most two ranges (from, up to)."""
    batches = epochs * num_steps
    if not n_tables or batches < 1:
        return []
    first = -(-(n_tables - start) // batch_size)
    if batches <= first:
        return [(start, min(start + batches * batch_size, n_tables))]
    again = min((batches - first) * batch_size, n_tables)
    return [(0, n_tables)] if again >= start else [(start, n_tables), (0, again)]


def start_of_epoch(epoch: int, num_steps: int, batch_size: int, n_tables: int) -> int:
    """The place where the batches of an epoch (from 0) start, for resuming."""
    each = -(-n_tables // batch_size)
    return (epoch * num_steps) % each * batch_size


def batch_facts(plan: DataFrame, datasets: DataFrame) -> DataFrame:
    """batch_no, n_tables, max_features, max_rows, and the first table's split_index. datasets: dataset_pos and its sizes."""
    d = plan.join(datasets, "dataset_pos")
    return d.groupBy("batch_no").agg(
        F.count("*").alias("n_tables"), F.max("n_features").alias("max_features"), F.max("n_rows").alias("max_rows"), F.min_by("split_index", "dataset_pos").alias("split_index")
    )


def bad_batches(rows: DataFrame) -> DataFrame:
    """batch_no of batches with a missing number among any row's features or the context's targets. rows: batch_no, x, y, is_context."""
    missing = lambda c: c.isNull() | F.isnan(c)
    bad = F.exists("x", missing) | (F.col("is_context") & missing(F.col("y")))
    return rows.groupBy("batch_no").agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad")).where("bad").select("batch_no")


def drop_bad_batches(rows: DataFrame) -> DataFrame:
    return rows.join(bad_batches(rows), "batch_no", "left_anti")


def accumulation_groups(losses: DataFrame, accumulate: int, num_steps: int) -> DataFrame:
    """group_no, n_batches, loss: mean of the batches' losses by update. losses: batch_no, loss."""
    if accumulate < 1 or num_steps % accumulate:
        raise ValueError("num_steps must be divisible by accumulate")
    return losses.groupBy(F.floor(F.col("batch_no") / accumulate).alias("group_no")).agg(F.count("*").alias("n_batches"), F.avg("loss").alias("loss"))


def epoch_loss(losses: DataFrame, num_steps: int) -> DataFrame:
    """epoch, mean_loss (over all steps, skipped ones in the divisor), loss_of_scored (over those that were scored)."""
    epoch = F.floor(F.col("batch_no") / num_steps).alias("epoch")
    return losses.groupBy(epoch).agg((F.sum("loss") / num_steps).alias("mean_loss"), F.avg("loss").alias("loss_of_scored"))


def batch_records(rows: DataFrame) -> DataFrame:
    """The four fields of a batch, by row: x, y, target_y (the same) and split_index."""
    return rows.select("batch_no", "dataset_id", "row_idx", "x", "y", F.col("y").alias("target_y"), "split_index")


def first_tables(rows: DataFrame, datasets: DataFrame, k: int, d: int) -> DataFrame:
    """Rows of the first k tables, with their first d features."""
    keep = datasets.where(F.col("dataset_pos") < k).select("dataset_id")
    return rows.join(keep, "dataset_id", "left_semi").withColumn("x", F.slice("x", 1, d))


def is_context(row: Column | str = "row_idx", split: Column | str = "split_index") -> Column:
    """True for the labelled rows before a table's split."""
    row, split = (F.col(c) if isinstance(c, str) else c for c in (row, split))
    return row < split

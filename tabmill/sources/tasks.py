"""Tasks and suites, saved weights and edges, and the table of run metrics."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmill.sources.log import CommitLog

# fixed values: the public task numbers of the built-in suites
TOY_REGRESSION = (362443,)
TOY_CLASSIFICATION = (59, 2382, 9946)
ARENA = (
    363612, 363613, 363614, 363615, 363616, 363618, 363619, 363620, 363621, 363623, 363624, 363625, 363626, 363627, 363628, 363629, 363630,
    363631, 363632, 363671, 363672, 363673, 363674, 363675, 363676, 363677, 363678, 363679, 363681, 363682, 363683, 363684, 363685, 363686,
    363689, 363691, 363693, 363694, 363696, 363697, 363698, 363699, 363700, 363702, 363704, 363705, 363706, 363707, 363708, 363711, 363712,
)
BUILT_IN = {"toy_regression": TOY_REGRESSION, "toy_classification": TOY_CLASSIFICATION, "tabarena-v0.1": ARENA}


def built_in_suites(spark: SparkSession) -> DataFrame:
    """suite, task_id: what resolve() takes beside a user's own suites."""
    return spark.createDataFrame([(name, k) for name, ids in BUILT_IN.items() for k in ids], "suite string, task_id int")


def resolve(tasks: DataFrame, suites: DataFrame, wanted: str | list[int]) -> DataFrame:
    """tasks of a suite's name or of a list of ids."""
    if isinstance(wanted, str):
        return tasks.join(suites.where(F.col("suite") == wanted).select("task_id"), "task_id", "left_semi")
    return tasks.where(F.col("task_id").isin(*wanted))


def with_target(table: DataFrame, target: str, row_id: str) -> DataFrame:
    """row_id, features, y: the target's column apart."""
    rest = [c for c in table.columns if c not in (target, row_id)]
    return table.select(F.col(row_id).alias("row_id"), *rest, F.col(target).alias("y"))


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r.name: np.array(r.data).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def log_metrics(metrics: DataFrame, path: str, source: str | None = None, batch: int | None = None) -> bool:
    """Commits rows of run, epoch, name, value to a log of metrics; of each (run, epoch, name), the latest commit's value counts.

    source and batch name a commit: what is written again under the same two (a micro-batch that is run again) changes nothing,
    and False is returned. A write that fails leaves nothing. Rows that share run, epoch and name within a commit are an error.
    """
    spark = metrics.sparkSession
    log = CommitLog(spark, f"{path}/commits")
    known = lambda entries: source is not None and any((e["source"], e["batch"]) == (source, batch) for e in entries)
    before = log.entries()
    if known(before):
        return False
    folder = uuid.uuid4().hex
    made = f"{path}/values/commit={folder}"
    metrics.select("run", "epoch", "name", F.col("value").cast("double").alias("value")).write.partitionBy("run").parquet(made)
    again = _values(spark, path, [folder]).groupBy("run", "epoch", "name").count().where("count > 1").limit(1).collect()
    if again:
        log.delete(made)
        raise ValueError(f"more than one value of {again[0].run}, {again[0].epoch}, {again[0]['name']}")
    while not log.put(before[-1]["no"] + 1 if before else 0, {"folder": folder, "source": source, "batch": batch}):
        before = log.entries()  # another writer came first
        if known(before):
            log.delete(made)
            return False
    return True


def _values(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    kinds = "epoch long, name string, value double, commit string, run string"
    if not folders:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", f"{path}/values").parquet(*(f"{path}/values/commit={f}" for f in folders))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, name, value: one row each, of the latest commit that has it."""
    entries = CommitLog(spark, f"{path}/commits").entries()
    order = F.broadcast(spark.createDataFrame([(e["folder"], e["no"]) for e in entries], "commit string, no long"))
    d = _values(spark, path, [e["folder"] for e in entries]).join(order, "commit")
    return d.groupBy("run", "epoch", "name").agg(F.max_by("value", "no").alias("value"))


def metrics_view(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """run, epoch, and a column per name."""
    return read_metrics(spark, path).groupBy("run", "epoch").pivot("name", names).agg(F.first("value"))

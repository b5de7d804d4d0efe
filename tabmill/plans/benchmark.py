"""Benchmarks: tasks chosen on their facts, predicted together or one plan each, scored together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.operators import metrics as M
from tabmill.operators.estimators import InContextClassifier, InContextRegressor
from tabmill.plans.folds import FoldedTask, predict_folds
from tabmill.sources.storage import written

PREDICTIONS = "dataset string, fold int, row_id long, y_true double, y_pred double, proba array<double>"


@dataclass(frozen=True)
class Task:
    """One table with a target. table: row_id, feature columns, y, is_context."""

    name: str
    task_type: str
    table: DataFrame
    columns: list[str]
    fold: int = 0


def predict(task: Task, classifier: Callable[[list[str]], InContextClassifier] = InContextClassifier, regressor: Callable[[list[str]], InContextRegressor] = InContextRegressor) -> DataFrame:
    """PREDICTIONS of a task's query rows."""
    classes = task.task_type == "classification"
    model = (classifier if classes else regressor)(task.columns).fit(task.table.where("is_context"))
    out = model.transform(task.table.where("not is_context"))
    proba = F.col("proba") if classes else F.lit(None).cast("array<double>")
    return out.select(F.lit(task.name).alias("dataset"), F.lit(task.fold).alias("fold"), F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("double").alias("y_true"), F.col("prediction").cast("double").alias("y_pred"), proba.alias("proba"))


def predict_all(tasks: list[Task]) -> DataFrame:
    """PREDICTIONS of all tasks and folds."""
    if not tasks:
        raise ValueError("no tasks")
    out = predict(tasks[0])
    for t in tasks[1:]:
        out = out.unionByName(predict(t))
    return out


def predict_with(rows: DataFrame, predictor: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """PREDICTIONS by a user's function of (context, query) frames with x and y; it returns y_pred, and proba or None, by query row.

    rows: dataset, fold, row_id, x, y, is_context; each (dataset, fold) is one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        query = pdf[~pdf["is_context"]].sort_values("row_id")
        got = predictor(pdf[pdf["is_context"]].sort_values("row_id"), query.drop(columns="y"))
        return pd.DataFrame({"dataset": query["dataset"], "fold": query["fold"], "row_id": query["row_id"], "y_true": query["y"].astype(float), "y_pred": got["y_pred"].to_numpy(float), "proba": list(got["proba"]) if "proba" in got else None})

    return rows.groupBy("dataset", "fold").applyInPandas(one, PREDICTIONS)


def score_classification(predictions: DataFrame) -> DataFrame:
    """dataset, metric, value: accuracy, balanced accuracy, ROC AUC (binary by the positive class, else one against the rest)."""
    predictions = written(predictions, "predictions")  # read by each metric
    two = predictions.withColumn("score", M.positive_score(F.col("proba")))
    binary = M.roc_auc(two.where("score is not null").withColumn("positive", F.col("y_true") == 1), ["dataset"])
    many = M.roc_auc_macro(two.where("score is null"), ["dataset"])
    out = M.long_form(M.accuracy(predictions, ["dataset"]), ["dataset"], "accuracy")
    out = out.unionByName(M.long_form(M.balanced_accuracy(predictions, ["dataset"]), ["dataset"], "balanced_accuracy"))
    return out.unionByName(M.long_form(binary, ["dataset"], "roc_auc")).unionByName(M.long_form(many, ["dataset"], "roc_auc"))


def score_regression(predictions: DataFrame) -> DataFrame:
    return M.long_form(M.r2(predictions, ["dataset"]), ["dataset"], "r2")


def run_benchmark(tasks: list[Task]) -> DataFrame:
    """dataset, metric, value, with each metric's mean over the datasets. Tasks of both types may be mixed; all are predicted as one
    job (predict_folds())."""
    if not tasks:
        raise ValueError("no tasks")
    # numbers stand for names meanwhile: a name may have several tasks, one a fold
    own = [FoldedTask(str(k), t.task_type, t.table, t.columns) for k, t in enumerate(tasks)]
    splits = None
    for k, t in enumerate(tasks):
        part = t.table.select(F.lit(str(k)).alias("dataset"), F.lit(t.fold).alias("fold"), "row_id", F.col("is_context").alias("is_train"))
        splits = part if splits is None else splits.unionByName(part)
    names = F.broadcast(tasks[0].table.sparkSession.createDataFrame([(str(k), t.name, t.task_type) for k, t in enumerate(tasks)], "dataset string, name string, task_type string"))
    found = written(predict_folds(own, splits).join(names, "dataset"), "predictions")
    parts = []
    for kind, score in (("classification", score_classification), ("regression", score_regression)):
        if any(t.task_type == kind for t in tasks):
            parts.append(score(found.where(F.col("task_type") == kind).select(F.col("name").alias("dataset"), "fold", "row_id", "y_true", "y_pred", "proba")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return M.with_average(out)

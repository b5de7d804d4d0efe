"""Classifier and regressor that learn in context: fit keeps the preprocessed training rows, transform lets them answer.

Up to max_context training rows are kept by the model, sent to every task, and answer in a projection, on streams too. More are
stored as a table that is streamed past the query rows (attend()), if the scorer is attention: transform() then takes batches,
whose row_id is one row each; a stream is scored by micro-batches (score_stream()).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.functions.arrays import argmax, softmax
from tabmill.operators.attention import MAX_CONTEXT, Score, StoredContext, attend, attention_scorer, collect_context, score_table, store_context
from tabmill.operators.distribution import distribution_mean
from tabmill.operators.normalize import fit_target_scaler
from tabmill.operators.preprocess import PreprocessorModel, TablePreprocessor


def _stored(train: DataFrame, n_classes: int | None, max_context: int, scorer: Score | None) -> StoredContext | None:
    """The training rows (row_id, x, y) as a stored context, if they are more than a model may hold."""
    if train.select("row_id").limit(max_context + 1).count() <= max_context:
        return None
    if scorer is not None:
        raise ValueError(f"more than {max_context} context rows")
    return store_context(train.withColumn("table", F.lit(0)), n_classes)


def _attended(df: DataFrame, stored: StoredContext) -> DataFrame:
    """df with output, by row_id."""
    if df.isStreaming:
        raise ValueError("this model's context is stored: score the stream by micro-batches (score_stream)")
    found = attend(stored, df.select(F.lit(0).alias("table"), "row_id", "x")).select(F.col("row_id").alias("_row"), "output")
    return df.join(found, F.col("row_id") == F.col("_row")).drop("_row")


@dataclass(frozen=True)
class ClassifierModel:
    preprocessor: PreprocessorModel
    x: np.ndarray
    y: np.ndarray
    n_classes: int
    score: Score
    logits: bool
    stored: StoredContext | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """df with proba (of the classes seen at fit) and prediction. df may be a stream, unless the context is stored."""
        d = self.preprocessor.transform(df, "x")
        out = score_table(d, self.x, self.y, self.score) if self.stored is None else _attended(d, self.stored)
        seen = F.slice("output", 1, self.n_classes)
        return out.withColumn("proba", softmax(seen) if self.logits else seen).withColumn("prediction", argmax(F.col("proba"))).drop("x", "output")


@dataclass(frozen=True)
class InContextClassifier:
    """scorer: a full model's scorer, whose outputs are logits; without one, attention over labels."""

    columns: list[str]
    scorer: Score | None = None
    max_context: int = MAX_CONTEXT

    def fit(self, df: DataFrame) -> ClassifierModel:
        """df: row_id, the columns, and y (0, 1, ...)."""
        pre = TablePreprocessor(self.columns).fit(df)
        train = pre.transform(df, "x")
        top = df.agg(F.max("y")).first()[0]
        n = 0 if top is None else int(top) + 1
        if stored := _stored(train, n, self.max_context, self.scorer):
            return ClassifierModel(pre, np.zeros((0, 0)), np.zeros(0), n, attention_scorer(n), False, stored)
        x, y = collect_context(train, self.max_context)
        return ClassifierModel(pre, x, y, n, self.scorer or attention_scorer(n), self.scorer is not None)


@dataclass(frozen=True)
class RegressorModel:
    preprocessor: PreprocessorModel
    x: np.ndarray
    y: np.ndarray
    mean: float
    std: float
    score: Score
    edges: list[float] | None
    stored: StoredContext | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction, on the target's own scale."""
        d = self.preprocessor.transform(df, "x")
        out = score_table(d, self.x, self.y, self.score) if self.stored is None else _attended(d, self.stored)
        z = F.get("output", F.lit(0)) if self.edges is None else distribution_mean(F.col("output"), self.edges)
        return out.withColumn("prediction", z * self.std + self.mean).drop("x", "output")


@dataclass(frozen=True)
class InContextRegressor:
    """scorer and edges: a full model's scorer, whose outputs are logits of the edges' buckets; without, attention over targets."""

    columns: list[str]
    scorer: Score | None = None
    edges: list[float] | None = None
    max_context: int = MAX_CONTEXT

    def fit(self, df: DataFrame) -> RegressorModel:
        pre = TablePreprocessor(self.columns).fit(df)
        train = pre.transform(df, "x")
        center, spread = fit_target_scaler(df)
        if stored := _stored(train.withColumn("y", (F.col("y") - center) / spread), None, self.max_context, self.scorer):
            return RegressorModel(pre, np.zeros((0, 0)), np.zeros(0), center, spread, attention_scorer(None), self.edges, stored)
        x, y = collect_context(train, self.max_context)
        mean = float(y.mean()) if len(y) else 0.0
        std = (float(y.std(ddof=1)) if len(y) > 1 else 0.0) + 1e-8
        return RegressorModel(pre, x, (y - mean) / std, mean, std, self.scorer or attention_scorer(None), self.edges)

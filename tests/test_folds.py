from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.plans import benchmark as E
from tabmill.plans import fixtures as X
from tabmill.plans import folds as L
from tabmill.plans.queries import ORACLES, QUERIES
from tests.oracle import compare


def tasks(spark, sf):
    """Three tasks: classes with numbers and categories, more classes, and numbers; values missing in each."""
    docs = X.document_task(spark, sf).withColumn("lang", F.when(F.col("row_id") % 7 > 0, F.col("lang"))).withColumn("n_words", F.when(F.col("row_id") % 11 > 0, F.col("n_words")))
    emb = X.embedding_task(spark, sf).where("row_id < 150").select("row_id", "y", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), F.lit("same").alias("k"))
    orders = X.order_task(spark, sf).where("row_id < 700").withColumn("y", F.col("price")).withColumn("o_orderpriority", F.when(F.col("row_id") % 13 > 0, F.col("o_orderpriority")))
    return [
        L.FoldedTask("docs", "classification", docs.withColumn("y", F.col("quality")), ["n_chars", "n_words", "uniq_ratio", "lang", "source"]),
        L.FoldedTask("emb", "classification", emb, ["a", "b", "k"]),
        L.FoldedTask("orders", "regression", orders, ["o_custkey", "o_orderpriority", "o_month"]),
    ]


def splits_of(own, folds):
    parts = [t.table.select(F.lit(t.name).alias("dataset"), "row_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")) for t in own]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.withColumn("is_train", F.col("row_id") % folds != F.col("fold"))


def rows_of(df):
    return {(r.dataset, r.fold, r.row_id): r for r in df.collect()}


def test_all_folds_at_once_are_what_each_gives_alone(spark, sf):
    own = tasks(spark, sf)
    single = [E.Task(t.name, t.task_type, t.table.withColumn("is_context", F.col("row_id") % 5 != f), t.columns, f) for t in own for f in range(5)]
    want, got = rows_of(E.predict_all(single)), rows_of(L.predict_folds(own, splits_of(own, 5)))
    assert got.keys() == want.keys() and len(want) > 300
    for k, w in want.items():
        assert got[k].y_true == w.y_true and got[k].y_pred == pytest.approx(w.y_pred, rel=1e-9), k
        assert (got[k].proba is None) == (w.proba is None) and (w.proba is None or np.allclose(got[k].proba, w.proba, atol=1e-9)), k


def test_jobs_do_not_grow_with_folds(spark, sf):
    own = tasks(spark, sf)[1:2]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages of a query are jobs of their own
    try:
        ran = []
        for folds in (2, 9):
            group = f"folds-{folds}"
            spark.sparkContext.setJobGroup(group, group)
            assert L.predict_folds(own, splits_of(own, folds)).count() == 150
            ran.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext._jsc.clearJobGroup()
    assert ran[0] == ran[1]


def test_large_contexts_and_limits(spark, sf):
    own = tasks(spark, sf)
    some = splits_of(own, 3)
    a, b = rows_of(L.predict_folds(own, some)), rows_of(L.predict_folds(own, some, max_context=60))
    assert a.keys() == b.keys() and all(a[k].y_pred == pytest.approx(b[k].y_pred) for k in a)
    with pytest.raises(ValueError, match="more than 3 categories"):
        L.predict_folds(own, some, max_categories=3)
    with pytest.raises(ValueError):
        L.predict_folds([], some)


def test_folds_query(spark, sf):
    assert compare(spark, "e1_folds", QUERIES["e1_folds"], ORACLES["e1_folds"], sf) == ""

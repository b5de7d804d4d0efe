"""Registered queries over the driver's tables, by operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmill.functions import kernel
from tabmill.functions.arrays import argmax, cross_entropy, softmax, to_columns
from tabmill.functions.numbers import to_number
from tabmill.operators import attention as A
from tabmill.operators import batches as B
from tabmill.operators import distribution as D
from tabmill.operators import metrics as M
from tabmill.operators import normalize as N
from tabmill.operators import preprocess as P
from tabmill.operators import profile as V
from tabmill.operators import splits as S
from tabmill.operators.estimators import InContextClassifier
from tabmill.plans import benchmark as E
from tabmill.plans import fixtures as X
from tabmill.plans import folds as L
from tabmill.plans.hashsql import uniform_sql
from tabmill.sources import collections as C
from tabmill.sources import generate as G
from tabmill.sources import tasks as T
from tabmill.sources.storage import scratch, written
from tabmill.streaming import replay as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 2402


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH RECURSIVE {','.join(ctes)} " if ctes else "") + sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


DS = ("dataset_id", "long")


def drawn(*parts) -> str:
    """SQL of uniform(SEED, ...)."""
    return uniform_sql(SEED, *parts)


#: some_tables() and the uniform features of their rows.
TABLES_SQL = f"""
sized AS (SELECT dataset_id, CAST(40 + floor({drawn("rows", DS)} * 11) AS INTEGER) AS n_rows, CAST(2 + floor({drawn("features", DS)} * 3) AS INTEGER) AS n_features FROM (SELECT DISTINCT user_id AS dataset_id FROM events)),
tables AS (SELECT dataset_id, n_rows, n_features, CAST(10 + floor({drawn("split", DS)} * (greatest(n_rows - 1, 10) - 9)) AS INTEGER) AS split_index FROM sized)"""
CELLS_SQL = f"""
places AS (SELECT dataset_id, n_rows, n_features, unnest(range(0, n_rows)) AS row_idx FROM tables),
cells AS (SELECT dataset_id, n_features, row_idx, list_transform(range(0, n_features), lambda k: {drawn("x", DS, ("row_idx", "int"), ("k", "int"))}) AS x FROM places)"""
#: What _generated() reports of a table's rows.
REPORT_SQL = "SELECT dataset_id, count(*) AS n_rows, CAST(max(len(x)) AS INTEGER) AS width, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_std, count(DISTINCT y) AS n_values FROM made GROUP BY dataset_id"
STEPS_SQL = f"""
made AS (SELECT dataset_id, row_idx, x, CAST(x[1 + CAST(floor({drawn("feature", DS)} * n_features) AS INTEGER)] > {drawn("threshold", DS, ("1", "int"))} AS DOUBLE) AS y FROM cells)"""
RULES_SQL = f"""
ruled AS (SELECT dataset_id, CAST(1 + floor({drawn("rank", DS)} * 20) AS INTEGER) AS n_rules, greatest(n_features - CASE WHEN {drawn("useless", DS)} < 0.3 THEN floor({drawn("how many", DS)} * (n_features * 0.3 + 1)) ELSE 0 END, 1) AS usable FROM tables),
rules AS (SELECT dataset_id, list_transform(range(1, n_rules + 1), lambda k: list_transform(range(1, 2 + CAST(floor({drawn("length", DS, ("k", "int"))} * 3) AS INTEGER)), lambda j:
       {{'at': 1 + CAST(floor({drawn("literal", DS, ("k", "int"), ("j", "int"))} * usable) AS INTEGER), 'is': CASE WHEN {drawn("value", DS, ("k", "int"), ("j", "int"))} < 0.5 THEN 0.0 ELSE 1.0 END}})) AS rules FROM ruled),
bits AS (SELECT dataset_id, row_idx, list_transform(x, lambda v: CASE WHEN v < 0.5 THEN 0.0 ELSE 1.0 END) AS x FROM cells),
made AS (SELECT dataset_id, row_idx, x, CAST(len(list_filter(rules, lambda r: len(list_filter(r, lambda t: x[t.at] <> t."is")) = 0)) > 0 AS DOUBLE) AS y FROM bits JOIN rules USING (dataset_id))"""
USED_SQL = f"""
made AS (SELECT dataset_id, row_idx, x[1:1 + CAST(floor({drawn("used", DS)} * n_features) AS INTEGER)] AS x, x[1] AS y FROM cells)"""

EV, EMB, DOC, ORD, MIX, TASK = X.EVENTS_SQL, X.EMBEDDINGS_SQL, X.DOCUMENTS_SQL, X.ORDERS_SQL, X.MIXED_SQL, X.TASKS_SQL
BATCH = 8


def one_pass(spark: SparkSession, datasets: DataFrame) -> DataFrame:
    n = datasets.count()
    return B.batch_plan(spark, n, BATCH, -(-n // BATCH))


def in_batches(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    rows, datasets = X.event_tables(spark, sf_dir, nulls)
    plan = one_pass(spark, datasets).join(datasets.select("dataset_pos", "dataset_id"), "dataset_pos").select("batch_no", "dataset_id")
    return rows.join(plan, "dataset_id")


# ---- sources and sinks


@query("s1_collection_scan", "SELECT dataset_pos // 8 AS batch_no, dataset_id, row_idx, round(x0, 6) AS x0, y, split_index FROM tt", (EV,))
def s1(spark, sf_dir):
    rows, datasets = X.event_tables(spark, sf_dir)
    out = C.scan_batches(rows.select("dataset_id", "row_idx", "x", "y"), datasets, one_pass(spark, datasets))
    return out.select("batch_no", "dataset_id", "row_idx", r6(F.get("x", F.lit(0))).alias("x0"), "y", "split_index")


@query("s2_metadata_probe", "SELECT count(*) AS n_tables, max(n_rows) AS max_rows, max(n_features) AS max_features, (SELECT max(k) FROM (SELECT count(DISTINCT y) AS k FROM ev GROUP BY dataset_id)) AS max_classes, true AS has_n_rows, 'classification' AS problem_type FROM datasets", (EV,))
def s2(spark, sf_dir):
    rows, datasets = X.event_tables(spark, sf_dir)
    return C.probe(datasets.join(V.classes_per_table(rows), "dataset_id"), "classification")


@query("s3_split_field", "SELECT dataset_id, CASE WHEN dataset_id % 2 = 0 THEN split_index ELSE split_index + 1 END AS split_index FROM datasets", (EV,))
def s3(spark, sf_dir):
    d = X.event_sizes(spark, sf_dir)
    old = d.select("dataset_id", F.when(F.col("dataset_id") % 2 == 0, F.col("split_index")).alias("train_test_split_index"), (F.col("split_index") + 1).alias("single_eval_pos"))
    return C.split_field(old)


@query("s4_collection_sink", "SELECT dataset_id, count(*) AS n_rows, round(sum(x0), 4) AS x0_sum, sum(y) AS y_sum, any_value(split_index) AS split_index, 'classification' AS problem_type FROM tt GROUP BY dataset_id", (EV,))
def s4(spark, sf_dir):
    rows, datasets = X.event_tables(spark, sf_dir)
    path = scratch(spark, "collection")
    C.write_collection(rows.select("dataset_id", "row_idx", "x", "y"), datasets, path, "classification", 5, BATCH)
    got, sizes, facts = C.read_collection(spark, path)
    by = got.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get("x", F.lit(0))), 4).alias("x0_sum"), F.sum("y").alias("y_sum"))
    return by.join(sizes.select("dataset_id", "split_index"), "dataset_id").withColumn("problem_type", F.lit(facts["problem_type"]))


@query("s4_append", "SELECT place // 8 AS batch_no, place AS dataset_pos, dataset_id, count(*) AS n_rows, round(sum(x0), 4) AS x0_sum, any_value(split_index) AS split_index FROM tt JOIN (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id % 3, dataset_id) - 1 AS place FROM datasets) USING (dataset_id) GROUP BY place, dataset_id", (EV,))
def s4_append(spark, sf_dir):
    """A collection that is started and appended to twice, read back batch by batch: positions go on from append to append."""
    rows = written(X.event_rows(spark, sf_dir).select("dataset_id", "row_idx", "x", "y"), "events")
    path = scratch(spark, "collection")
    for k in range(3):
        part = rows.where(F.col("dataset_id") % 3 == k)
        C.write_collection(part, C.describe(part), path, "classification", 5, BATCH, "append" if k else "overwrite")
    c = C.open_collection(spark, path)
    d = c.scan(BATCH, -(-c.n_tables // BATCH))
    return d.groupBy("batch_no", "dataset_pos", "dataset_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get("x", F.lit(0))), 4).alias("x0_sum"), F.first("split_index").alias("split_index"))


WRAPPED = """
steps AS (SELECT k AS batch_no, CASE WHEN k < 2 THEN n - 12 + k * 8 ELSE (k - 2) * 8 END AS lo, n FROM range(0, 4) g(k) CROSS JOIN (SELECT count(*) AS n FROM datasets)),
members AS (SELECT batch_no, unnest(range(lo, least(lo + 8, n))) AS dataset_pos FROM steps)"""


@query("s1_pruned_scan", "SELECT batch_no, dataset_pos, dataset_id, row_idx, round(x0, 6) AS x0, y, split_index FROM members JOIN tt USING (dataset_pos)", (EV, WRAPPED))
def s1_pruned(spark, sf_dir):
    """Four batches of a stored collection, from twelve tables before its end on: the blocks between are not read."""
    rows, datasets = X.event_tables(spark, sf_dir)
    path = scratch(spark, "collection")
    C.write_collection(rows.select("dataset_id", "row_idx", "x", "y"), datasets, path, "classification", 5, BATCH, block_tables=16)
    c = C.open_collection(spark, path)
    return c.scan(BATCH, 4, start=c.n_tables - 12).select("batch_no", "dataset_pos", "dataset_id", "row_idx", r6(F.get("x", F.lit(0))).alias("x0"), "y", "split_index")


LONGEST, WIDEST = 128, 5


@query("s5_pad", "SELECT d.dataset_id, CAST(g.k AS INTEGER) AS row_idx, round(coalesce(x0, 0), 6) AS x0, coalesce(x2, 0) AS x2, 0.0::DOUBLE AS x4, coalesce(y, 0) AS y FROM datasets d CROSS JOIN range(0, 128) g(k) LEFT JOIN ev ON ev.dataset_id = d.dataset_id AND row_idx = g.k", (EV,))
def s5(spark, sf_dir):
    d = C.pad_collection(X.event_rows(spark, sf_dir).select("dataset_id", "row_idx", "x", "y"), LONGEST, WIDEST)
    return d.select("dataset_id", "row_idx", r6(F.get("x", F.lit(0))).alias("x0"), F.get("x", F.lit(2)).alias("x2"), F.get("x", F.lit(4)).alias("x4"), "y")


@query("s6_trim", "SELECT dataset_id, row_idx, 3 AS width, round(x0, 6) AS x0, y FROM ev", (EV,))
def s6(spark, sf_dir):
    rows, datasets = X.event_tables(spark, sf_dir)
    padded = C.pad_collection(rows.select("dataset_id", "row_idx", "x", "y"), LONGEST, WIDEST)
    return C.trim_collection(padded, datasets).select("dataset_id", "row_idx", F.size("x").alias("width"), r6(F.get("x", F.lit(0))).alias("x0"), "y")


def _grid_batch(batch_size: int, num_datapoints_max: int, num_features: int) -> dict:
    t, r, c = np.ogrid[:batch_size, :num_datapoints_max, :num_features]
    x = ((t + 1) * r * (c + 1) % 7 + c / 4).astype(float)
    return {"x": x, "y": x.sum(2), "train_test_split_index": num_datapoints_max // 2}


GRID = "(t % 8 + 1) * r * (c + 1) % 7 + c / 4"


@query("s7_function_source", f"SELECT CAST(t // 8 AS BIGINT) AS step, CAST(t AS BIGINT) AS dataset_id, CAST(20 AS BIGINT) AS n_rows, 10 AS split_index, round(sum({GRID}), 6) AS y_sum, round(sum(r * ({GRID})) FILTER (c = 1), 6) AS x1_by_row FROM range(0, (SELECT ((count(DISTINCT user_id) + 7) // 8) * 8 FROM events)) a(t) CROSS JOIN range(0, 20) b(r) CROSS JOIN range(0, 3) d(c) GROUP BY t")
def s7(spark, sf_dir):
    n = X.read(spark, sf_dir, "events").select("user_id").distinct().count()
    rows = C.from_function(spark, _grid_batch, -(-n // BATCH), BATCH, 20, 3)
    x1 = F.sum(F.col("row_idx") * F.get("x", F.lit(1)))
    return rows.groupBy("step", "dataset_id").agg(F.count("*").alias("n_rows"), F.max("split_index").alias("split_index"), r6(F.sum("y")).alias("y_sum"), r6(x1).alias("x1_by_row"))


@query("s8_axis_layout", "SELECT dataset_pos // 8 AS batch_no, dataset_id, row_idx, round(x0, 6) AS x0, y FROM tt", (EV,))
def s8(spark, sf_dir):
    nested = C.rows_first(in_batches(spark, sf_dir).select("batch_no", "dataset_id", "row_idx", "x", "y"))
    return C.tables_first(nested).select("batch_no", "dataset_id", "row_idx", r6(F.get("x", F.lit(0))).alias("x0"), "y")


def some_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic table for each of the events' users."""
    users = X.read(spark, sf_dir, "events").select(F.col("user_id").alias("dataset_id")).distinct()
    return G.draw_sizes(users, SEED, (40, 50), (2, 4), 10)


@query("s9_generate_and_dump", "SELECT dataset_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(floor(count(*) * 0.6) AS INTEGER) AS split_index, sum(y) AS y_sum, round(sum(x[1]), 6) AS x0_sum, 'classification' AS problem_type FROM made GROUP BY dataset_id", (TABLES_SQL, CELLS_SQL, STEPS_SQL))
def s9(spark, sf_dir):
    rows, kind = G.generate_collection(some_tables(spark, sf_dir), "step_function", SEED)
    path = scratch(spark, "generated")
    C.write_collection(rows, C.describe(rows), path, kind, 2, BATCH)
    got, datasets, facts = C.read_collection(spark, path)
    by = got.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.sum("y").alias("y_sum"), r6(F.sum(F.get("x", F.lit(0)))).alias("x0_sum"))
    return by.join(datasets.select("dataset_id", "split_index"), "dataset_id").withColumn("problem_type", F.lit(facts["problem_type"]))


@query("s10_suite", "SELECT task_id, dataset_name, n_samples FROM tasks WHERE n_features <= 5", (TASK,))
def s10(spark, sf_dir):
    tasks = X.task_facts(spark, sf_dir)
    suites = tasks.where("n_features <= 5").select(F.lit("narrow").alias("suite"), "task_id")
    return T.resolve(tasks, suites, "narrow").select("task_id", "dataset_name", "n_samples")


@query("s11_load_with_target", "SELECT row_id, o_custkey, o_orderpriority, o_month, price AS y FROM ords", (ORD,))
def s11(spark, sf_dir):
    return T.with_target(X.order_task(spark, sf_dir).drop("status", "fold", "is_context"), "price", "row_id")


@query("s12_saved_weights")
def s12(spark, sf_dir):
    """Query rows scored with weights that were written and read back."""
    path = scratch(spark, "weights")
    T.save_weights(spark, kernel.random_weights(1, 2, 8, 16, 5), path)
    rows, _ = X.event_tables(spark, sf_dir)
    return A.score_collection(rows, A.model_scorer(T.load_weights(spark, path))).select("dataset_id", "row_idx", argmax(F.col("output")).alias("prediction"))


@query("s12_saved_arrays", "SELECT CAST(label AS INTEGER) AS label, CAST(k AS INTEGER) AS k, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY label, k")
def s12_arrays(spark, sf_dir):
    """Named arrays, the labels' mean vectors, written as weights and read back."""
    e = X.read(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("k", "v"))
    by = e.groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c"))
    path = scratch(spark, "weights")
    T.save_weights(spark, {f"label.{r.label}": np.array([c.m for c in r.c]) for r in by.collect()}, path)
    back = [(int(name.removeprefix("label.")), k, float(v)) for name, w in T.load_weights(spark, path).items() for k, v in enumerate(w)]
    return spark.createDataFrame(back, "label int, k int, mean double").withColumn("mean", r6("mean"))


#: Of tables that hold more than MAX_Y targets the first count, as bucket_edges() states.
EDGES = """
zz AS (SELECT e.dataset_id, dataset_pos, row_idx, round((value - m) / (s + 1e-8), 9) AS z FROM ev e JOIN datasets USING (dataset_id) JOIN (SELECT dataset_id, avg(value) AS m, stddev_samp(value) AS s FROM ev GROUP BY dataset_id) USING (dataset_id)),
used AS (SELECT * FROM zz WHERE dataset_pos < {most} // (SELECT max(n_rows) FROM datasets)),
cut AS (SELECT z FROM used QUALIFY row_number() OVER (ORDER BY dataset_pos, row_idx) <= (SELECT count(*) - count(*) % 10 FROM used)),
ranked AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS r, count(*) OVER () // 10 AS m FROM cut),
edge AS (SELECT 0 AS k, min(z) AS z FROM cut UNION ALL SELECT 10, max(z) FROM cut UNION ALL SELECT CAST(k AS INTEGER), avg(z) FROM ranked JOIN range(1, 10) g(k) ON r = m * k - 1 OR r = m * k GROUP BY k),
edges AS (SELECT k AS bucket, z AS lo, lead(z) OVER (ORDER BY k) AS hi FROM edge QUALIFY hi IS NOT NULL)""".replace("{most}", str(N.MAX_Y))


def event_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, _ = X.event_tables(spark, sf_dir)
    rows = rows.select("dataset_id", "dataset_pos", "row_idx", F.col("value").alias("y"))
    return rows, N.bucket_edges(rows, 10)


@query("s13_saved_edges", "SELECT bucket, round(lo, 6) AS lo, round(hi, 6) AS hi FROM edges", (EV, EDGES))
def s13(spark, sf_dir):
    return written(event_edges(spark, sf_dir)[1], "edges").select("bucket", r6("lo").alias("lo"), r6("hi").alias("hi"))


def batch_losses(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """A loss per batch: the mean squared distance of the query targets from their table's context mean."""
    rows = in_batches(spark, sf_dir, nulls)
    rows = N.fill_targets(B.drop_bad_batches(rows) if nulls else rows)
    return rows.where("not is_context").groupBy("batch_no").agg(F.avg(F.pow(F.col("y") - F.col("y_known"), 2)).alias("loss"))


LOSSES = """
known AS (SELECT dataset_id, avg(y) AS m FROM tt WHERE is_context GROUP BY dataset_id),
losses AS (SELECT dataset_pos // 8 AS batch_no, avg(pow(y - m, 2)) AS loss FROM tt JOIN known USING (dataset_id) WHERE NOT is_context GROUP BY 1)"""
BAD = """, bad AS (SELECT DISTINCT dataset_pos // 8 AS batch_no FROM tt WHERE event_id % 997 = 0)"""


@query("s14_metrics_sink", "SELECT 'first' AS run, batch_no // 4 AS epoch, round(avg(loss), 6) AS loss, CAST(count(*) AS DOUBLE) AS n FROM losses GROUP BY batch_no // 4", (EV, LOSSES))
def s14(spark, sf_dir):
    by = batch_losses(spark, sf_dir).groupBy(F.floor(F.col("batch_no") / 4).alias("epoch")).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
    path = scratch(spark, "metrics")
    for name in ("loss", "n"):
        T.log_metrics(by.select(F.lit("first").alias("run"), "epoch", F.lit(name).alias("name"), F.col(name).cast("double").alias("value")), path)
    return T.metrics_view(spark, path, ["loss", "n"]).withColumn("loss", r6("loss"))


# ---- batch plans

POINTER = """
ptr(batch_no, place) AS (SELECT CAST(0 AS BIGINT), CAST(3 AS BIGINT) UNION ALL SELECT batch_no + 1, CASE WHEN place + 7 >= (SELECT count(*) FROM datasets) THEN 0 ELSE place + 7 END
       FROM ptr WHERE batch_no < 2 * ((SELECT count(*) FROM datasets) // 5) - 1)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    datasets = X.event_sizes(spark, sf_dir)
    n = datasets.count()
    return B.batch_plan(spark, n, 7, n // 5, epochs=2, start=3), datasets, n


@query("b1_b2_b3_batch_plan", "SELECT batch_no, batch_no // ((SELECT count(*) FROM datasets) // 5) AS epoch, dataset_pos FROM ptr JOIN datasets ON dataset_pos >= place AND dataset_pos < place + 7", (EV, POINTER))
def b123(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("batch_no", "epoch", "dataset_pos")


@query("b4_batch_facts", "SELECT batch_no, count(*) AS n_tables, max(n_features) AS max_features, max(n_rows) AS max_rows, arg_min(split_index, dataset_pos) AS split_index FROM ptr JOIN datasets ON dataset_pos >= place AND dataset_pos < place + 7 GROUP BY batch_no", (EV, POINTER))
def b4(spark, sf_dir):
    plan, datasets, _ = _plan(spark, sf_dir)
    return B.batch_facts(plan, datasets)


@query("b5_drop_bad_batches", "SELECT dataset_pos // 8 AS batch_no, count(*) AS n_rows FROM tt WHERE dataset_pos // 8 NOT IN (SELECT batch_no FROM bad) GROUP BY 1", (EV + BAD,))
def b5(spark, sf_dir):
    return B.drop_bad_batches(in_batches(spark, sf_dir, nulls=True)).groupBy("batch_no").agg(F.count("*").alias("n_rows"))


@query("b6_accumulation_groups", "SELECT batch_no // 4 AS group_no, count(*) AS n_batches, round(avg(loss), 6) AS loss FROM losses GROUP BY 1", (EV, LOSSES))
def b6(spark, sf_dir):
    return B.accumulation_groups(batch_losses(spark, sf_dir), 4, 8).withColumn("loss", r6("loss"))


@query("b7_epoch_loss", "SELECT batch_no // 4 AS epoch, round(sum(loss) / 4, 6) AS mean_loss, round(avg(loss), 6) AS loss_of_scored FROM losses WHERE batch_no NOT IN (SELECT batch_no FROM bad) GROUP BY 1", (EV, LOSSES + BAD))
def b7(spark, sf_dir):
    d = B.epoch_loss(batch_losses(spark, sf_dir, nulls=True), 4)
    return d.select("epoch", r6("mean_loss").alias("mean_loss"), r6("loss_of_scored").alias("loss_of_scored"))


# ---- projections, filters, splits


@query("p1_context_split", "SELECT dataset_id, row_idx, is_context, CASE WHEN is_context THEN y END AS known_y FROM tt", (EV,))
def p1(spark, sf_dir):
    rows, _ = X.event_tables(spark, sf_dir)
    return rows.withColumn("is_context", B.is_context()).select("dataset_id", "row_idx", "is_context", F.when(F.col("is_context"), F.col("y")).alias("known_y"))


@query("p2_listed_split", "SELECT row_id, price, fold <> 2 AS is_context FROM ords", (ORD,))
def p2(spark, sf_dir):
    return S.split_by_list(X.order_task(spark, sf_dir).select("row_id", "price"), X.order_splits(spark, sf_dir), 6, fold=2)


@query("p3_concatenate", "SELECT row_id, is_context, CASE WHEN is_context THEN y END AS y, (SELECT count(*) FROM emb WHERE is_context) AS split_index FROM emb", (EMB.split("cells AS")[0].rstrip().rstrip(","),))
def p3(spark, sf_dir):
    e = X.embedding_task(spark, sf_dir)
    both = S.join_train_test(e.where("is_context").select("row_id", "y"), e.where("not is_context").select("row_id"))
    return both.select("row_id", "is_context", "y", both.agg(F.count_if(F.col("is_context")).alias("n")).scalar().alias("split_index"))


@query("p4_task_type", "SELECT task_id FROM tasks WHERE task_type = 'regression'", (TASK,))
def p4(spark, sf_dir):
    return S.of_type(X.task_facts(spark, sf_dir), False).select("task_id")


@query("p5_task_size", "SELECT task_id, n_features, n_samples FROM tasks WHERE n_features <= 500 AND n_samples <= 10000", (TASK,))
def p5(spark, sf_dir):
    return S.small_enough(X.task_facts(spark, sf_dir)).select("task_id", "n_features", "n_samples")


@query("p6_fold", "SELECT t AS task_id, 0 AS fold, row_id, fold <> 0 AS is_train FROM ords CROSS JOIN (VALUES (5), (6)) v(t)", (ORD,))
def p6(spark, sf_dir):
    return S.chosen_folds(X.order_splits(spark, sf_dir)).select("task_id", "fold", "row_id", "is_train")


@query("p7_drop_constant", "SELECT row_id, round(num_null, 2) AS num_null, cat_null FROM mixed", (MIX,))
def p7(spark, sf_dir):
    d = X.mixed_table(spark, sf_dir).select("row_id", "num_null", "cat_null", "const", "empty")
    kind = {r.column: r.kind for r in P.column_kinds(d, ["num_null", "cat_null", "const", "empty"]).collect()}
    return d.drop(*(c for c, k in kind.items() if k == "dropped")).withColumn("num_null", F.round("num_null", 2))


@query("p8_array_to_columns", "SELECT row_id, round(x[1], 6) AS f0, round(x[2], 6) AS f1, round(x[64], 6) AS f63 FROM emb", (EMB.split("cells AS")[0].rstrip().rstrip(","),))
def p8(spark, sf_dir):
    e = X.embedding_task(spark, sf_dir)
    return e.select("row_id", *to_columns(F.col("x"), [f"f{k}" for k in range(64)])).select("row_id", *(r6(c).alias(c) for c in ("f0", "f1", "f63")))


@query("p9_batch_record", "SELECT dataset_pos // 8 AS batch_no, dataset_id, row_idx, y, y AS target_y, split_index FROM tt", (EV,))
def p9(spark, sf_dir):
    return B.batch_records(in_batches(spark, sf_dir)).drop("x")


@query("p10_first_tables", "SELECT dataset_id, row_idx, 2 AS width, round(x0, 6) AS x0, x1 FROM tt WHERE dataset_pos < 4", (EV,))
def p10(spark, sf_dir):
    rows, datasets = X.event_tables(spark, sf_dir)
    d = B.first_tables(rows, datasets, 4, 2)
    return d.select("dataset_id", "row_idx", F.size("x").alias("width"), r6(F.get("x", F.lit(0))).alias("x0"), F.get("x", F.lit(1)).alias("x1"))


@query("p11_random_split", f"SELECT o_orderkey, {uniform_sql(42, ('o_orderkey', 'long'))} < 0.5 AS is_train FROM orders")
def p11(spark, sf_dir):
    return X.read(spark, sf_dir, "orders").select("o_orderkey", S.random_split(F.col("o_orderkey")).alias("is_train"))


# ---- preprocessing

PROFILE = """
long AS (UNPIVOT (SELECT row_id, CAST(num_null AS VARCHAR) AS num_null, num_str, cat_null, "const", "empty", mostly_num, cat_unseen FROM mixed WHERE row_id % 2 = 0) ON num_null, num_str, cat_null, "const", "empty", mostly_num, cat_unseen INTO NAME "column" VALUE v),
cols AS (SELECT unnest(['num_null', 'num_str', 'cat_null', 'const', 'empty', 'mostly_num', 'cat_unseen']) AS "column"),
profile AS (SELECT c."column", count(v) AS n_present, count(DISTINCT v) AS n_distinct, count(TRY_CAST(v AS DOUBLE)) AS n_numeric FROM cols c LEFT JOIN long USING ("column") GROUP BY 1)"""


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mixed_table(spark, sf_dir).where("row_id % 2 = 0")


@query("f1_f2_column_profile", """SELECT *, CASE WHEN n_distinct <= 1 THEN 'dropped' WHEN n_present = n_numeric THEN 'numeric' ELSE 'categorical' END AS kind FROM profile""", (MIX, PROFILE))
def f12(spark, sf_dir):
    return P.column_profile(_train(spark, sf_dir), X.MIXED_COLUMNS)


@query("f3_numeric_coercion", "SELECT row_id, TRY_CAST(mostly_num AS DOUBLE) AS mostly_num, TRY_CAST(num_str AS DOUBLE) AS num_str FROM mixed", (MIX,))
def f3(spark, sf_dir):
    d = X.mixed_table(spark, sf_dir)
    return d.select("row_id", to_number(F.col("mostly_num")).alias("mostly_num"), to_number(F.col("num_str")).alias("num_str"))


FITTED = """
train AS (SELECT * FROM mixed WHERE row_id % 2 = 0),
means AS (SELECT avg(num_null) AS m1, avg(TRY_CAST(num_str AS DOUBLE)) AS m2 FROM train),
codes AS (SELECT v, k, CAST(row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS DOUBLE) AS code, n FROM (
       SELECT v, k, count(*) AS n FROM (SELECT cat_null AS v, 'cat_null' AS k FROM train UNION ALL SELECT mostly_num, 'mostly_num' FROM train UNION ALL SELECT cat_unseen, 'cat_unseen' FROM train) WHERE v IS NOT NULL GROUP BY v, k)),
fill AS (SELECT k, code FROM codes QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, code) = 1),
coded AS (SELECT x.*, a.code AS c1, b.code AS c2, c.code AS c3 FROM mixed x LEFT JOIN codes a ON a.k = 'cat_null' AND a.v = cat_null LEFT JOIN codes b ON b.k = 'mostly_num' AND b.v = mostly_num LEFT JOIN codes c ON c.k = 'cat_unseen' AND c.v = cat_unseen)"""


def _fitted(spark: SparkSession, sf_dir: str) -> P.PreprocessorModel:
    return P.TablePreprocessor(X.MIXED_COLUMNS).fit(_train(spark, sf_dir))


@query("f4_f5_mean_impute", "SELECT row_id, round(coalesce(num_null, m1), 4) AS num_null, CAST(num_null IS NULL AS DOUBLE) AS num_null_missing, round(coalesce(TRY_CAST(num_str AS DOUBLE), m2), 4) AS num_str, CAST(num_str IS NULL AS DOUBLE) AS num_str_missing FROM mixed CROSS JOIN means", (MIX, FITTED))
def f45(spark, sf_dir):
    d = X.mixed_table(spark, sf_dir)
    m = P.TablePreprocessor(["num_null", "num_str"]).fit(_train(spark, sf_dir))
    out = dict(zip(m.feature_names, m.features(d), strict=True))
    return d.select("row_id", *(F.round(out[c], 4).alias(c) for c in ("num_null", "num_null_missing", "num_str", "num_str_missing")))


@query("f6_ordinal_codes", 'SELECT k AS "column", v AS value, code, n FROM codes', (MIX, FITTED))
def f6(spark, sf_dir):
    return P.ordinal_codes(_train(spark, sf_dir), ["cat_null", "mostly_num", "cat_unseen"])


@query("f7_most_frequent", 'SELECT k AS "column", code FROM fill', (MIX, FITTED))
def f7(spark, sf_dir):
    return P.most_frequent(P.ordinal_codes(_train(spark, sf_dir), ["cat_null", "mostly_num", "cat_unseen"]))


@query("f8_f9_preprocessor", """SELECT row_id, round(coalesce(num_null, m1), 4) AS x0, round(coalesce(TRY_CAST(num_str AS DOUBLE), m2), 4) AS x1, CAST(num_null IS NULL AS DOUBLE) AS x2, CAST(num_str IS NULL AS DOUBLE) AS x3,
       coalesce(c1, (SELECT code FROM fill WHERE k = 'cat_null')) AS x4, coalesce(c2, (SELECT code FROM fill WHERE k = 'mostly_num')) AS x5, coalesce(c3, (SELECT code FROM fill WHERE k = 'cat_unseen')) AS x6, CAST(c1 IS NULL AS DOUBLE) AS x7 FROM coded CROSS JOIN means""", (MIX, FITTED))
def f89(spark, sf_dir):
    d = _fitted(spark, sf_dir).transform(X.mixed_table(spark, sf_dir))
    return d.select("row_id", *(F.round(F.get("x", F.lit(k)), 4).alias(f"x{k}") for k in range(8)))


@query("f10_label_encoding", "SELECT row_id, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INTEGER) AS y FROM ords", (ORD,))
def f10(spark, sf_dir):
    o = X.order_task(spark, sf_dir)
    return P.encode_labels(o, "status", P.label_codes(o.where("is_context"), "status")).select("row_id", "y")


@query("f11_class_count", "SELECT max(label) + 1 AS n_classes FROM embeddings")
def f11(spark, sf_dir):
    return P.class_count(X.embedding_task(spark, sf_dir))


# ---- normalisation and buckets

ZTT = """
st AS (SELECT dataset_id, avg(x0) AS m0, stddev_samp(x0) AS s0, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x2) AS m2, stddev_samp(x2) AS s2, avg(y) AS my, stddev_samp(y) AS sy FROM tt WHERE is_context GROUP BY dataset_id),
ztt AS (SELECT tt.*, (x0 - m0) / (s0 + 1e-8) AS z0, (x1 - m1) / (s1 + 1e-8) AS z1, (x2 - m2) / (s2 + 1e-8) AS z2, my, (y - my) / (sy + 1e-8) AS zy FROM tt JOIN st USING (dataset_id))"""


@query("n1_feature_zscore", "SELECT dataset_id, row_idx, round(z0, 5) AS z0, round(z1, 5) AS z1, round(z2, 5) AS z2 FROM ztt", (EV, ZTT))
def n1(spark, sf_dir):
    d = N.normalize_features(X.event_tables(spark, sf_dir)[0], 3, bound=None)
    return d.select("dataset_id", "row_idx", *(F.round(F.get("x", F.lit(k)), 5).alias(f"z{k}") for k in range(3)))


@query("n2_clip", "SELECT dataset_id, row_idx, round(least(greatest(z0, -1), 1), 5) AS z0 FROM ztt", (EV, ZTT))
def n2(spark, sf_dir):
    d = N.normalize_features(X.event_tables(spark, sf_dir)[0], 3, bound=1.0)
    return d.select("dataset_id", "row_idx", F.round(F.get("x", F.lit(0)), 5).alias("z0"))


@query("n3_target_zscore", "SELECT dataset_id, row_idx, round(zy, 5) AS y_norm FROM ztt", (EV, ZTT))
def n3(spark, sf_dir):
    return N.normalize_targets(X.event_tables(spark, sf_dir)[0]).select("dataset_id", "row_idx", F.round("y_norm", 5).alias("y_norm"))


@query("n4_target_scaler", "SELECT row_id, round((price - (SELECT avg(price) FROM ords)) / ((SELECT stddev_samp(price) FROM ords) + 1e-8), 5) AS scaled, round(price, 2) AS back FROM ords", (ORD,))
def n4(spark, sf_dir):
    o = X.order_task(spark, sf_dir)
    mean, std = N.fit_target_scaler(o, "price")
    d = o.withColumn("scaled", (F.col("price") - mean) / std)
    return d.select("row_id", F.round("scaled", 5).alias("scaled"), F.round(F.col("scaled") * std + mean, 2).alias("back"))


@query("n5_fill_targets", "SELECT dataset_id, row_idx, round(CASE WHEN is_context THEN y ELSE my END, 6) AS y_known FROM ztt", (EV, ZTT))
def n5(spark, sf_dir):
    return N.fill_targets(X.event_tables(spark, sf_dir)[0]).select("dataset_id", "row_idx", r6("y_known").alias("y_known"))


@query("n6_bucket_edges", "SELECT bucket, round(lo, 6) AS lo, round(hi, 6) AS hi FROM edges", (EV, EDGES))
def n6(spark, sf_dir):
    return event_edges(spark, sf_dir)[1].select("bucket", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("n7_bucketize", "SELECT bucket, count(*) AS n FROM zz JOIN edges ON (z >= lo OR bucket = 0) AND (z < hi OR bucket = 9) GROUP BY bucket", (EV, EDGES))
def n7(spark, sf_dir):
    rows, edges = event_edges(spark, sf_dir)
    return N.bucketize(N.scaled_targets(rows), written(edges, "edges"), "z").groupBy("bucket").agg(F.count("*").alias("n"))


# ---- in-context scoring

VOTES = """
zc AS (SELECT dataset_id, row_idx, y, is_context, least(greatest(z0, -100), 100) AS z0, least(greatest(z1, -100), 100) AS z1, least(greatest(z2, -100), 100) AS z2, value FROM ztt),
pr AS (SELECT q.dataset_id, q.row_idx, q.y AS y_true, c.y, c.value, (q.z0 * c.z0 + q.z1 * c.z1 + q.z2 * c.z2) / sqrt(3) AS s FROM zc q JOIN zc c USING (dataset_id) WHERE NOT q.is_context AND c.is_context),
wt AS (SELECT dataset_id, row_idx, y_true, y, value, exp(s - max(s) OVER (PARTITION BY dataset_id, row_idx)) AS e FROM pr),
sh AS (SELECT dataset_id, row_idx, any_value(y_true) AS y_true, y, sum(e) AS e FROM wt GROUP BY dataset_id, row_idx, y),
tot AS (SELECT dataset_id, row_idx, sum(e) AS t FROM sh GROUP BY dataset_id, row_idx),
pb AS (SELECT q.dataset_id, q.row_idx, q.y AS y_true, CAST(k AS INTEGER) AS class, coalesce(e, 0) / t AS p FROM zc q JOIN tot USING (dataset_id, row_idx) CROSS JOIN range(0, 5) g(k) LEFT JOIN sh ON sh.dataset_id = q.dataset_id AND sh.row_idx = q.row_idx AND sh.y = k WHERE NOT q.is_context),
best AS (SELECT dataset_id, row_idx, y_true, class AS y_pred FROM pb QUALIFY row_number() OVER (PARTITION BY dataset_id, row_idx ORDER BY round(p, 9) DESC, class) = 1)"""


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, y_true, y_pred, proba of all query rows of tt_events, each table answered by its own context."""
    rows, _ = X.event_tables(spark, sf_dir)
    out = A.score_collection(rows, A.attention_scorer(5))
    rounded = F.transform("output", lambda p: F.round(p, 9))
    return out.select(F.col("dataset_id").cast("string").alias("dataset"), "dataset_id", "row_idx", F.col("y").alias("y_true"), argmax(rounded).cast("double").alias("y_pred"), F.col("output").alias("proba"))


@query("a1_context_attention", "SELECT dataset_id, CAST(row_idx AS BIGINT) AS row_idx, class, round(p, 6) AS p FROM pb", (EV, ZTT, VOTES))
def a1(spark, sf_dir):
    d = event_predictions(spark, sf_dir)
    return d.select("dataset_id", "row_idx", F.posexplode("proba").alias("class", "p")).withColumn("p", r6("p"))


@query("a1_one_table_attention", "SELECT row_id, class, round(p, 6) AS p FROM proba", (EMB,))
def a1_one(spark, sf_dir):
    e = X.embedding_task(spark, sf_dir)
    out = A.attend_table(e.where("is_context"), e.where("not is_context"))
    return out.select("row_id", F.posexplode("output").alias("class", "p")).withColumn("p", r6("p"))


@query("a2_full_model")
def a2(spark, sf_dir):
    """Logits of every table's query rows by a small model with drawn weights."""
    rows, _ = X.event_tables(spark, sf_dir)
    out = A.score_collection(rows, A.model_scorer(kernel.random_weights(2, 2, 16, 32, 5)))
    return out.select("dataset_id", "row_idx", F.transform("output", lambda v: F.round(v, 6)).alias("logits"))


@query("a3_a4_softmax_argmax", "SELECT row_id, round(exp(x[1] - list_max(x[1:10])) / list_sum(list_transform(x[1:10], lambda v: exp(v - list_max(x[1:10])))), 6) AS p0, CAST(list_position(x[1:10], list_max(x[1:10])) - 1 AS INTEGER) AS prediction FROM emb", (EMB.split("cells AS")[0].rstrip().rstrip(","),))
def a34(spark, sf_dir):
    e = X.embedding_task(spark, sf_dir).withColumn("proba", softmax(F.slice("x", 1, 10)))
    return e.select("row_id", r6(F.get("proba", F.lit(0))).alias("p0"), argmax(F.col("proba")).alias("prediction"))


MEANS = """
means AS (SELECT bucket, CASE bucket WHEN 0 THEN hi - (hi - lo) * sqrt(2 / pi()) / 0.6744897501960817 WHEN 9 THEN lo + (hi - lo) * sqrt(2 / pi()) / 0.6744897501960817 ELSE (lo + hi) / 2 END AS m FROM edges),
lg AS (SELECT vec_id AS row_id, unnest(CAST(embedding AS DOUBLE[])[1:10]) AS v, generate_subscripts(embedding[1:10], 1) - 1 AS bucket FROM embeddings)"""


@query("a5_distribution_mean", "SELECT row_id, round(sum(exp(v) * m) / sum(exp(v)), 5) AS mean FROM lg JOIN means USING (bucket) GROUP BY row_id", (EV, EDGES, MEANS))
def a5(spark, sf_dir):
    edges = event_edges(spark, sf_dir)[1].orderBy("bucket").collect()
    at = [r.lo for r in edges] + [edges[-1].hi]
    return X.embedding_task(spark, sf_dir).select("row_id", F.round(D.distribution_mean(F.slice("x", 1, 10), at), 5).alias("mean"))


@query("a6_loss", "SELECT dataset_id // 8 AS batch_no, round(avg(-ln((p + 1e-6) / (1 + 5e-6))), 5) AS loss FROM pb WHERE class = y_true GROUP BY 1", (EV, ZTT, VOTES))
def a6(spark, sf_dir):
    d = event_predictions(spark, sf_dir)
    smooth = F.transform("proba", lambda p: (p + 1e-6) / (1 + 5e-6))
    d = d.withColumn("loss", cross_entropy(smooth, F.col("y_true")))
    return d.groupBy(F.floor(F.col("dataset_id") / 8).alias("batch_no")).agg(F.round(F.avg("loss"), 5).alias("loss"))


LOSS = """
zb AS (SELECT dataset_id, z, bucket, lo, hi FROM zz JOIN edges ON (z >= lo OR bucket = 0) AND (z < hi OR bucket = 9)),
scale AS (SELECT *, (hi - lo) / 0.6744897501960817 AS s FROM zb)"""


@query("a6_bucket_loss", "SELECT dataset_id, round(avg(ln(10) + CASE bucket WHEN 0 THEN ln(s) - ln(2 / sqrt(2 * pi())) + pow((hi - z) / s, 2) / 2 WHEN 9 THEN ln(s) - ln(2 / sqrt(2 * pi())) + pow((z - lo) / s, 2) / 2 ELSE ln(hi - lo) END), 6) AS loss FROM scale GROUP BY dataset_id", (EV, EDGES, LOSS))
def a6_bucket(spark, sf_dir):
    """Mean negative log density of the scaled values under flat logits, by table."""
    rows, edges = event_edges(spark, sf_dir)
    at = [r.lo for r in edges.orderBy("bucket").collect()]
    last = edges.agg(F.max("hi")).first()[0]
    z = N.bucketize(N.scaled_targets(rows), written(edges, "edges"), "z")
    flat = F.array_repeat(F.lit(0.0), len(at))
    return z.groupBy("dataset_id").agg(r6(F.avg(D.bucket_loss(flat, F.col("bucket"), F.col("z"), [*at, last]))).alias("loss"))


@query("a7_classifier", "SELECT row_id, y_true AS y, y_pred AS prediction FROM pred", (EMB,))
def a7(spark, sf_dir):
    names = [f"f{k}" for k in range(64)]
    e = X.embedding_task(spark, sf_dir).select("row_id", "y", "is_context", *to_columns(F.col("x"), names))
    model = InContextClassifier(names).fit(e.where("is_context"))
    return model.transform(e.where("not is_context")).select("row_id", "y", "prediction")


@query("a8_regressor", "SELECT dataset_id, CAST(row_idx AS BIGINT) AS row_idx, round(sum(e * value) / sum(e), 5) AS prediction FROM wt GROUP BY dataset_id, row_idx", (EV, ZTT, VOTES))
def a8(spark, sf_dir):
    rows, _ = X.event_tables(spark, sf_dir)
    scaled = rows.withColumn("y", F.col("value"))
    stats = scaled.where("is_context").groupBy("dataset_id").agg(F.avg("y").alias("m"), (F.stddev_samp("y") + 1e-8).alias("s"))
    out = A.score_collection(N.normalize_targets(scaled).drop("y").withColumnRenamed("y_norm", "y"), A.attention_scorer(None))
    back = out.join(stats, "dataset_id").withColumn("prediction", F.get("output", F.lit(0)) * F.col("s") + F.col("m"))
    return back.select("dataset_id", "row_idx", F.round("prediction", 5).alias("prediction"))


@query("a8_bucket_regressor")
def a8_buckets(spark, sf_dir):
    """Regression by a model's logits over bucket edges: every table's query rows get the mean of their distribution, on the
    table's own scale. The weights are drawn; the edges are those of the collection."""
    edges = event_edges(spark, sf_dir)[1].orderBy("bucket").collect()
    at = [r.lo for r in edges] + [edges[-1].hi]
    rows = X.event_tables(spark, sf_dir)[0].withColumn("y", F.col("value"))
    stats = rows.where("is_context").groupBy("dataset_id").agg(F.avg("y").alias("m"), (F.stddev_samp("y") + N.EPSILON).alias("s"))
    out = A.score_collection(N.normalize_targets(rows).drop("y").withColumnRenamed("y_norm", "y"), A.model_scorer(kernel.random_weights(1, 2, 8, 16, len(at) - 1)))
    back = out.join(stats, "dataset_id").withColumn("prediction", D.distribution_mean(F.col("output"), at) * F.col("s") + F.col("m"))
    return back.select("dataset_id", "row_idx", F.round("prediction", 5).alias("prediction"))


# ---- evaluation

AUC = """
cls AS (SELECT dataset_id, class, p, y_true = class AS pos FROM pb),
grp AS (SELECT dataset_id, class, p, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM cls GROUP BY dataset_id, class, p),
won AS (SELECT dataset_id, class, np, nn, np * (coalesce(sum(nn) OVER (PARTITION BY dataset_id, class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + nn / 2) AS w FROM grp),
auc AS (SELECT dataset_id, avg(a) AS a FROM (SELECT dataset_id, sum(w) / nullif(sum(np) * sum(nn), 0) AS a FROM won GROUP BY dataset_id, class) GROUP BY dataset_id),
bal AS (SELECT dataset_id, avg(r) AS b FROM (SELECT dataset_id, y_true, avg(CAST(y_pred = y_true AS DOUBLE)) AS r FROM best GROUP BY dataset_id, y_true) GROUP BY dataset_id),
acc AS (SELECT dataset_id, avg(CAST(y_pred = y_true AS DOUBLE)) AS c FROM best GROUP BY dataset_id)"""


@query("e1_predictions", "SELECT CAST(dataset_id AS VARCHAR) AS dataset, CAST(row_idx AS BIGINT) AS row_idx, y_true, CAST(y_pred AS DOUBLE) AS y_pred FROM best", (EV, ZTT, VOTES))
def e1(spark, sf_dir):
    return event_predictions(spark, sf_dir).select("dataset", "row_idx", "y_true", "y_pred")


@query("e2_positive_score", "SELECT row_id, round(uniq_ratio, 6) AS score FROM docs WHERE uniq_ratio IS NOT NULL", (DOC,))
def e2(spark, sf_dir):
    d = X.document_task(spark, sf_dir).where("uniq_ratio is not null")
    return d.select("row_id", r6(M.positive_score(F.array(1 - F.col("uniq_ratio"), F.col("uniq_ratio")))).alias("score"))


@query("e3_binary_auc", "SELECT lang, round(sum(w) / nullif(sum(np) * sum(nn), 0), 6) AS roc_auc FROM (SELECT lang, np, nn, np * (coalesce(sum(nn) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + nn / 2) AS w FROM (SELECT lang, round(uniq_ratio, 3) AS s, count(*) FILTER (quality = 1) AS np, count(*) FILTER (quality <> 1) AS nn FROM docs GROUP BY lang, s)) GROUP BY lang", (DOC,))
def e3(spark, sf_dir):
    d = X.document_task(spark, sf_dir).select("lang", F.round("uniq_ratio", 3).alias("score"), (F.col("quality") == 1).alias("positive"))
    return M.roc_auc(d, ["lang"]).withColumn("roc_auc", r6("roc_auc"))


@query("e4_macro_auc", "SELECT CAST(dataset_id AS VARCHAR) AS dataset, round(a, 4) AS roc_auc FROM auc", (EV, ZTT, VOTES, AUC))
def e4(spark, sf_dir):
    return M.roc_auc_macro(event_predictions(spark, sf_dir), ["dataset"]).withColumn("roc_auc", F.round("roc_auc", 4))


@query("e5_accuracy", "SELECT CAST(dataset_id AS VARCHAR) AS dataset, round(c, 6) AS accuracy FROM acc", (EV, ZTT, VOTES, AUC))
def e5(spark, sf_dir):
    return M.accuracy(event_predictions(spark, sf_dir), ["dataset"]).withColumn("accuracy", r6("accuracy"))


@query("e6_balanced_accuracy", "SELECT CAST(dataset_id AS VARCHAR) AS dataset, round(b, 6) AS balanced_accuracy FROM bal", (EV, ZTT, VOTES, AUC))
def e6(spark, sf_dir):
    return M.balanced_accuracy(event_predictions(spark, sf_dir), ["dataset"]).withColumn("balanced_accuracy", r6("balanced_accuracy"))


R2 = """
rg AS (SELECT dataset_id, row_idx, sum(e * value) / sum(e) AS p FROM wt GROUP BY dataset_id, row_idx),
rr AS (SELECT dataset_id, value AS t, p, avg(value) OVER (PARTITION BY dataset_id) AS m FROM rg JOIN ev USING (dataset_id, row_idx))"""


@query("e7_r2", "SELECT dataset_id, round(1 - sum(pow(t - p, 2)) / sum(pow(t - m, 2)), 4) AS r2 FROM rr GROUP BY dataset_id", (EV, ZTT, VOTES, R2))
def e7(spark, sf_dir):
    truth = X.event_rows(spark, sf_dir).select("dataset_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("value").alias("y_true"))
    d = a8(spark, sf_dir).withColumnRenamed("prediction", "y_pred").join(truth, ["dataset_id", "row_idx"])
    return M.r2(d, ["dataset_id"]).withColumn("r2", F.round("r2", 4))


@query("e8_macro_average", "SELECT 'accuracy' AS metric, round(avg(c), 5) AS value FROM acc UNION ALL SELECT 'balanced_accuracy', round(avg(b), 5) FROM bal UNION ALL SELECT 'roc_auc', round(avg(a), 5) FROM auc", (EV, ZTT, VOTES, AUC))
def e8(spark, sf_dir):
    return benchmark(spark, sf_dir).where("dataset = 'average'").select("metric", F.round("value", 5).alias("value"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_average(E.score_classification(written(event_predictions(spark, sf_dir), "predictions")))


ALL = """
metric AS (SELECT CAST(dataset_id AS VARCHAR) AS dataset, 'accuracy' AS metric, c AS value FROM acc UNION ALL SELECT CAST(dataset_id AS VARCHAR), 'balanced_accuracy', b FROM bal UNION ALL SELECT CAST(dataset_id AS VARCHAR), 'roc_auc', a FROM auc)"""


@query("e9_benchmark", "SELECT dataset, metric, round(value, 4) AS value FROM metric UNION ALL SELECT 'average', metric, round(avg(value), 4) FROM metric GROUP BY metric", (EV, ZTT, VOTES, AUC, ALL))
def e9(spark, sf_dir):
    """The flagship: every table of a collection answered in context, then scored, and the scores averaged."""
    return benchmark(spark, sf_dir).withColumn("value", F.round("value", 4))


@query("e9_task_benchmark")
def e9_tasks(spark, sf_dir):
    """Tasks of both kinds on tables of their own, with mixed columns; those past the size limits are left out beforehand."""
    facts = S.small_enough(X.task_facts(spark, sf_dir)).select("dataset_name").collect()
    docs = X.document_task(spark, sf_dir)
    columns = ["n_chars", "n_words", "uniq_ratio", "lang", "source"]
    names = [f"f{k}" for k in range(64)]
    emb = lambda binary: X.embedding_task(spark, sf_dir, binary).select("row_id", "y", "is_context", *to_columns(F.col("x"), names))
    orders = X.order_task(spark, sf_dir)
    tasks = [
        E.Task("emb", "classification", emb(False), names), E.Task("emb_binary", "classification", emb(True), names),
        E.Task("docs_quality", "classification", docs.withColumn("y", F.col("quality")), columns), E.Task("docs_toxic", "classification", docs.withColumn("y", F.col("toxic")), columns),
        E.Task("orders_price", "regression", orders.withColumn("y", F.col("price")), ["o_custkey", "o_orderpriority", "o_month"]),
    ]
    own = [t for t in tasks if t.name in {r.dataset_name for r in facts}]
    if not own:
        return spark.createDataFrame([], "dataset string, metric string, value double")
    return E.run_benchmark(own).withColumn("value", r6("value"))


FOLDS = """
coded AS (SELECT fold, lang, row_number() OVER (PARTITION BY fold ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT fold, lang FROM docs CROSS JOIN range(0, 5) f(fold) WHERE row_id % 5 <> fold)),
fx AS (SELECT fold, row_id, quality AS y, row_id % 5 <> fold AS train, [CAST(n_chars AS DOUBLE), CAST(n_words AS DOUBLE), CAST(code AS DOUBLE)] AS x FROM docs CROSS JOIN range(0, 5) f(fold) JOIN coded USING (fold, lang)),
fc AS (SELECT fold, row_id, y, train, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM fx),
fs AS (SELECT fold, k, avg(v) AS m, stddev_samp(v) AS s FROM fc WHERE train GROUP BY fold, k),
fz AS (SELECT fold, row_id, any_value(y) AS y, any_value(train) AS train, list(least(greatest((v - m) / (s + 1e-8), -100), 100) ORDER BY k) AS z FROM fc JOIN fs USING (fold, k) GROUP BY fold, row_id),
fp AS (SELECT q.fold, q.row_id, q.y AS y_true, c.y, list_dot_product(q.z, c.z) / sqrt(3) AS s FROM fz q JOIN fz c ON q.fold = c.fold AND NOT q.train AND c.train),
fv AS (SELECT fold, row_id, any_value(y_true) AS y_true, y, sum(exp(s - t)) AS e FROM fp JOIN (SELECT fold, row_id, max(s) AS t FROM fp GROUP BY fold, row_id) USING (fold, row_id) GROUP BY fold, row_id, y)"""


@query("e1_folds", "SELECT 'docs_quality' AS dataset, CAST(fold AS INTEGER) AS fold, count(*) AS n, round(avg(CAST(y = y_true AS DOUBLE)), 6) AS accuracy FROM (SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY fold, row_id ORDER BY e DESC, y) = 1) GROUP BY fold", (DOC, FOLDS))
def e1_folds(spark, sf_dir):
    """Five folds of a task in one job: each document is answered by those of the other folds."""
    docs = X.document_task(spark, sf_dir).withColumn("y", F.col("quality"))
    own = docs.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    splits = own.select(F.lit("docs_quality").alias("dataset"), "fold", "row_id", (F.col("row_id") % 5 != F.col("fold")).alias("is_train"))
    out = written(L.predict_folds([L.FoldedTask("docs_quality", "classification", docs, ["n_chars", "n_words", "lang"])], splits), "predictions")
    n = out.groupBy("dataset", "fold").agg(F.count("*").alias("n"))
    return M.accuracy(out, ["dataset", "fold"]).join(n, ["dataset", "fold"]).withColumn("accuracy", r6("accuracy"))


@query("e10_evaluation_log", "SELECT 'toy' AS run, e AS epoch, round(avg(value) FILTER (metric = 'roc_auc'), 4) AS roc_auc, round(avg(value) FILTER (metric = 'accuracy'), 4) AS accuracy FROM metric CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (2)) v(e) GROUP BY e", (EV, ZTT, VOTES, AUC, ALL))
def e10(spark, sf_dir):
    """The same predictor scored after each of two epochs, logged, and viewed by name."""
    path = scratch(spark, "log")
    scores = written(benchmark(spark, sf_dir).where("dataset = 'average'"), "scores")
    for epoch in (1, 2):
        T.log_metrics(scores.select(F.lit("toy").alias("run"), F.lit(epoch).cast("long").alias("epoch"), F.col("metric").alias("name"), "value"), path)
    return T.metrics_view(spark, path, ["roc_auc", "accuracy"]).select("run", "epoch", F.round("roc_auc", 4).alias("roc_auc"), F.round("accuracy", 4).alias("accuracy"))


# ---- profiles


@query("v1_shapes", "SELECT count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows, max(n_rows) AS max_rows, max(n_features) AS max_features, min(split_index) AS min_split, max(split_index) AS max_split FROM datasets", (EV,))
def v1(spark, sf_dir):
    return V.shape_summary(*X.event_tables(spark, sf_dir))


@query("v2_target_range", "SELECT dataset_id, min(y) AS y_min, max(y) AS y_max FROM ev GROUP BY ROLLUP (dataset_id)", (EV,))
def v2(spark, sf_dir):
    return V.target_range(X.event_rows(spark, sf_dir))


@query("v3_class_distribution", "SELECT y, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ev), 6) AS percent FROM ev GROUP BY y", (EV,))
def v3(spark, sf_dir):
    return V.class_distribution(X.event_rows(spark, sf_dir)).withColumn("percent", r6("percent"))


@query("v4_centroids", "SELECT dataset_id, y, count(*) AS n, round(avg(x0), 9) AS x0_mean, round(avg(x1), 9) AS x1_mean, max(k) AS n_classes FROM ev JOIN (SELECT dataset_id, count(DISTINCT y) AS k FROM ev GROUP BY dataset_id) USING (dataset_id) GROUP BY dataset_id, y", (EV,))
def v4(spark, sf_dir):
    rows = X.event_rows(spark, sf_dir)
    d = V.class_centroids(rows).join(V.classes_per_table(rows), "dataset_id")
    return d.select("dataset_id", "y", "n", F.round("x0_mean", 9).alias("x0_mean"), F.round("x1_mean", 9).alias("x1_mean"), "n_classes")


# ---- synthetic tables, one for each of the events' users


def _generated(name: str, build: Callable[[DataFrame], DataFrame], made: tuple[str, ...] = ()) -> None:
    """made: SQL of the same rows, where the prior is drawn natively."""

    @query(name, REPORT_SQL if made else None, (TABLES_SQL, CELLS_SQL, *made) if made else ())
    def run(spark, sf_dir):
        rows = build(some_tables(spark, sf_dir))
        return rows.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.max(F.size("x")).alias("width"), F.round(F.avg("y"), 6).alias("y_mean"), F.round(F.stddev_samp("y"), 6).alias("y_std"), F.count_distinct("y").alias("n_values"))


_generated("g1_mlp", lambda t: G.mlp(t, SEED))
_generated("g2_gp", lambda t: G.gp(t, SEED))
_generated("g3_step_function", lambda t: G.step_function(t, SEED), (STEPS_SQL,))
_generated("g4_boolean_conjunctions", lambda t: G.boolean_conjunctions(t, SEED), (RULES_SQL,))
_generated("g5_classification_adapter", lambda t: G.as_classification(G.mlp(t, SEED), t, SEED, 5))
_generated("g10_used_features", lambda t: G.used_features(G.cells(t, SEED).withColumn("y", F.get("x", F.lit(0))), t, SEED), (USED_SQL,))
_generated("g12_mlp_second", lambda t: G.mlp(t, SEED, G.MLP_B))
_generated("g13_gp_second", lambda t: G.gp(t, SEED, G.GP_B))
_generated("g14_bag", lambda t: G.bag(t, SEED))
_generated("g15_regression", lambda t: G.generate_collection(t, "prior_bag", SEED, 0)[0])


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.event_rows(spark, sf_dir).select("dataset_id", "row_idx", "x", F.col("value").alias("y"))


@query("g6_classes_by_rank", "SELECT dataset_id, row_idx, CAST(((row_number() OVER (PARTITION BY dataset_id ORDER BY value, row_idx) - 1) * 4) // count(*) OVER (PARTITION BY dataset_id) AS DOUBLE) AS y FROM ev", (EV,))
def g6(spark, sf_dir):
    d = _values(spark, sf_dir)
    return G.classes_by_rank(d, d.select("dataset_id").distinct().withColumn("n_classes", F.lit(4)), SEED, balanced=True).select("dataset_id", "row_idx", "y")


BOUNDARIES = f"""
place AS (SELECT dataset_id, row_idx, value, row_number() OVER (PARTITION BY dataset_id ORDER BY value, row_idx) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM ev),
cut_at AS (SELECT dataset_id, n, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT dataset_id, n FROM place)),
bounds AS (SELECT c.dataset_id, p.value AS cut FROM (SELECT dataset_id, 1 + CAST(floor({drawn("boundary", DS, ("k", "int"))} * n) AS BIGINT) AS r FROM cut_at) c JOIN place p USING (dataset_id, r))"""


@query("g6_drawn_boundaries", "SELECT dataset_id, row_idx, CAST((SELECT count(*) FROM bounds b WHERE b.dataset_id = p.dataset_id AND b.cut < p.value) AS DOUBLE) AS y FROM place p", (EV, BOUNDARIES))
def g6_drawn(spark, sf_dir):
    d = _values(spark, sf_dir)
    return G.classes_by_rank(d, d.select("dataset_id").distinct().withColumn("n_classes", F.lit(4)), SEED).select("dataset_id", "row_idx", "y")


RENAMED = f"""
named AS (SELECT dataset_id, {drawn("ordered", DS)} < 0.1 AS stays, list_transform(list_sort(list_transform(range(0, 5), lambda k: {{'u': {drawn("order", DS, ("k", "int"))}, 'k': k}})), lambda o: o.k) AS places FROM datasets)"""


@query("g7_class_order", "SELECT dataset_id, row_idx, CASE WHEN stays THEN y ELSE CAST(places[1 + CAST(y AS INTEGER)] AS DOUBLE) END AS y FROM ev JOIN named USING (dataset_id)", (EV, RENAMED))
def g7(spark, sf_dir):
    d = X.event_rows(spark, sf_dir)
    return G.shuffle_classes(d, d.select("dataset_id").distinct().withColumn("n_classes", F.lit(5)), SEED).select("dataset_id", "row_idx", "y")


CATEGORIES = ", ".join(f"CASE WHEN {drawn('categorical', DS, (str(k), 'int'))} < 0.15 THEN CAST(ntile(5) OVER (PARTITION BY dataset_id ORDER BY x{k}, row_idx) - 1 AS DOUBLE) ELSE round(x{k}, 6) END AS x{k}" for k in range(3))


@query("g8_categorical_features", f"SELECT dataset_id, row_idx, {CATEGORIES} FROM ev", (EV,))
def g8(spark, sf_dir):
    d = G.categorical_features(_values(spark, sf_dir), SEED)
    return d.select("dataset_id", "row_idx", r6(F.get("x", F.lit(0))).alias("x0"), F.get("x", F.lit(1)).alias("x1"), F.get("x", F.lit(2)).alias("x2"))


ROW = ("row_idx", "int")
MISSING = " + ".join(f"CAST({drawn('missing', DS, ROW, (str(k), 'int'))} < 0.05 OR ({drawn('reason', DS, (str(k), 'int'))} < 0.03 AND x{k} > 0.5 AND {drawn('set', DS, ROW, (str(k), 'int'))} < 0.9) AS BIGINT)" for k in range(3))


@query("g9_missing_values", f"SELECT dataset_id, CAST(sum({MISSING}) AS BIGINT) AS n_missing, count(*) AS n_rows FROM ev GROUP BY dataset_id", (EV,))
def g9(spark, sf_dir):
    d = G.missing_values(_values(spark, sf_dir), SEED)
    return d.groupBy("dataset_id").agg(F.sum(F.size(F.filter("x", lambda v: v.isNull()))).alias("n_missing"), F.count("*").alias("n_rows"))


@query("g11_class_counts", f"SELECT dataset_id, CASE WHEN {drawn('two', DS)} < 0.5 THEN 2 ELSE CAST(2 + floor({drawn('classes', DS)} * 9) AS INTEGER) END AS n_classes FROM tables", (TABLES_SQL,))
def g11(spark, sf_dir):
    return G.class_counts(some_tables(spark, sf_dir), SEED, 10).select("dataset_id", "n_classes")


@query("g16_g17_sizes", "SELECT dataset_id, n_rows, n_features, split_index FROM tables", (TABLES_SQL,))
def g16(spark, sf_dir):
    return some_tables(spark, sf_dir)


# ---- streams and user functions


@query("t1_replay", "SELECT dataset_id, CAST(count(*) AS BIGINT) AS n_rows, round(sum(x0), 4) AS x0_sum FROM ev GROUP BY dataset_id", (EV,))
def t1(spark, sf_dir):
    source, out = scratch(spark, "stored"), scratch(spark, "replayed")
    X.event_rows(spark, sf_dir).select("dataset_id", "row_idx", "x", "y").repartition(4, "dataset_id").write.parquet(source)
    R.run_once(R.replay(spark, source, C.ROWS), R.to_table(out), scratch(spark, "state"))
    got = spark.read.schema(C.ROWS).parquet(f"{out}/*")
    return got.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get("x", F.lit(0))), 4).alias("x0_sum"))


@query("t1_ordered_replay", "SELECT dataset_pos // 8 AS batch_no, dataset_pos // 24 AS micro_batch, dataset_id, count(*) AS n_rows, round(sum(x0), 4) AS x0_sum, any_value(split_index) AS split_index FROM tt GROUP BY dataset_pos, dataset_id", (EV,))
def t1_ordered(spark, sf_dir):
    """A stored collection replayed in its order, three batches a micro-batch, stopped after the first half and resumed. A trigger
    takes as many whole micro-batches as its tables allow."""
    rows, datasets = X.event_tables(spark, sf_dir)
    path, out, state = scratch(spark, "collection"), scratch(spark, "replayed"), scratch(spark, "state")
    C.write_collection(rows.select("dataset_id", "row_idx", "x", "y"), datasets, path, "classification", 5, BATCH, block_tables=24)
    steps = -(-C.open_collection(spark, path).n_tables // BATCH)
    many = R.TRIGGER_TABLES // (3 * BATCH)
    if half := steps // 6 * 3:
        R.replay_batches(spark, path, R.to_table(out, name="trigger"), state, BATCH, half, each=3, at_once=many)
    R.replay_batches(spark, path, R.to_table(out, name="trigger"), state, BATCH, steps, each=3, at_once=many)
    got = spark.read.option("basePath", out).parquet(f"{out}/*")
    got = got.groupBy("batch_no", "micro_batch", "dataset_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get("x", F.lit(0))), 4).alias("x0_sum"), F.first("split_index").alias("split_index"))
    return got


@query("t2_stream_scoring", "SELECT row_id, y_pred AS prediction FROM pred", (EMB,))
def t2(spark, sf_dir):
    names = [f"f{k}" for k in range(64)]
    e = X.embedding_task(spark, sf_dir).select("row_id", "y", "is_context", *to_columns(F.col("x"), names))
    model = InContextClassifier(names).fit(e.where("is_context"))
    source, out = scratch(spark, "arriving"), scratch(spark, "scored")
    e.where("not is_context").repartition(3, "row_id").write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    # by micro-batches, which a model of any context answers: one whose context is stored can't be a projection of the stream
    R.score_stream(stream, lambda df: model.transform(df).select("row_id", "prediction"), R.to_table(out), scratch(spark, "state"))
    return spark.read.schema("row_id long, prediction int").parquet(f"{out}/*")


@query("t3_running_metrics", "SELECT 'stream' AS run, batch_no // 4 AS epoch, count(*) AS n_batches, round(sum(loss) / 4, 6) AS mean_loss FROM losses GROUP BY 2", (EV, LOSSES))
def t3(spark, sf_dir):
    source, out = scratch(spark, "losses"), scratch(spark, "metrics")
    batch_losses(spark, sf_dir).withColumn("run", F.lit("stream")).repartition(3, "batch_no").write.parquet(source)
    stream = R.replay(spark, source, "batch_no long, loss double, run string")
    R.run_once(R.running_losses(stream, 4), R.to_metrics(out, "losses"), scratch(spark, "state"), "update")
    d = T.metrics_view(spark, out, ["n_batches", "mean_loss"])
    return d.select("run", "epoch", F.col("n_batches").cast("long").alias("n_batches"), r6("mean_loss").alias("mean_loss"))


@query("u2_epoch_hook", "SELECT 'stream' AS run, batch_no // 4 AS epoch, count(*) AS n_batches, round(sum(loss) / 4, 6) AS mean_loss FROM losses GROUP BY 2", (EV, LOSSES))
def u2(spark, sf_dir):
    """A user's function takes each epoch's metrics whenever they change; what it was given last of an epoch is the whole of it."""
    source, out = scratch(spark, "losses"), scratch(spark, "hook")
    batch_losses(spark, sf_dir).withColumn("run", F.lit("stream")).repartition(3, "batch_no").write.parquet(source)
    stream = R.replay(spark, source, "batch_no long, loss double, run string")
    R.run_once(R.running_losses(stream, 4), R.at_epoch_end(lambda df: df.write.mode("append").parquet(out)), scratch(spark, "state"), "update")
    told = spark.read.schema("run string, epoch long, n_batches long, mean_loss double").parquet(out)
    last = told.groupBy("run", "epoch").agg(F.max_by(F.struct("n_batches", "mean_loss"), "n_batches").alias("m"))
    return last.select("run", "epoch", "m.n_batches", r6("m.mean_loss").alias("mean_loss"))


def _majority(context: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"y_pred": np.full(len(query), context["y"].mode().min())})


@query("u3_user_predictor", "SELECT CAST(dataset_id AS VARCHAR) AS dataset, round(avg(CAST(y = common AS DOUBLE)), 6) AS accuracy FROM tt JOIN (SELECT dataset_id, y AS common FROM (SELECT dataset_id, y, count(*) AS n FROM tt WHERE is_context GROUP BY dataset_id, y) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, y) = 1) USING (dataset_id) WHERE NOT is_context GROUP BY dataset_id", (EV,))
def u3(spark, sf_dir):
    rows, _ = X.event_tables(spark, sf_dir)
    d = rows.select(F.col("dataset_id").cast("string").alias("dataset"), F.lit(0).alias("fold"), F.col("row_idx").cast("long").alias("row_id"), "x", "y", "is_context")
    return M.accuracy(E.predict_with(d, _majority), ["dataset"]).withColumn("accuracy", r6("accuracy"))

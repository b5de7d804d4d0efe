"""The driver's tables as collections and tasks (see FIXTURES.md), and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmill.sources.collections import describe


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_rows(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """tt_events: a table per user. dataset_id, row_idx, x (value, hour, day), y (the event type's place), event_id, value."""
    e = read(spark, sf_dir, "events")
    # five types: their order is one small array
    types = e.agg(F.array_sort(F.collect_set("event_type")).alias("types")).scalar()
    e = e.withColumn("y", F.array_position(types, F.col("event_type")) - 1)
    value = F.when(F.col("event_id") % 997 != 0, F.col("value")) if nulls else F.col("value")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("dataset_id"),
        (F.row_number().over(w) - 1).cast("int").alias("row_idx"),
        F.array(value, F.hour("ts").cast("double"), F.dayofmonth("ts").cast("double")).alias("x"),
        F.col("y").cast("double").alias("y"), "event_id", "value",
    )


def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """datasets of tt_events, from ids and counts alone."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("dataset_id"))
    return describe(e, n_features=F.lit(3))


def event_tables(spark: SparkSession, sf_dir: str, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows (with is_context and split_index) and datasets of tt_events."""
    datasets = event_sizes(spark, sf_dir)
    marked = event_rows(spark, sf_dir, nulls).join(datasets.select("dataset_id", "split_index", "dataset_pos"), "dataset_id")
    return marked.withColumn("is_context", F.col("row_idx") < F.col("split_index")), datasets


EVENTS_SQL = """
ev AS (SELECT event_id, user_id AS dataset_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS row_idx,
       value, value AS x0, CAST(hour(ts) AS DOUBLE) AS x1, CAST(day(ts) AS DOUBLE) AS x2,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS y FROM events),
datasets AS (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS dataset_pos, n_rows, 3 AS n_features,
       CAST(floor(n_rows * 0.6) AS INTEGER) AS split_index FROM (SELECT dataset_id, count(*) AS n_rows FROM ev GROUP BY dataset_id)),
tt AS (SELECT ev.*, split_index, dataset_pos, row_idx < split_index AS is_context FROM ev JOIN datasets USING (dataset_id))"""


def embedding_task(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """t_emb: row_id, x, y, is_context. Rows without a usable vector or label aren't in it."""
    e = read(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    y = (F.col("label") >= 5).cast("int") if binary else F.col("label")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), y.alias("y"), (F.col("vec_id") % 2 == 0).alias("is_context"))


EMBEDDINGS_SQL = """
emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label AS y, vec_id % 2 = 0 AS is_context FROM embeddings),
cells AS (SELECT row_id, y, is_context, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM emb),
stats AS (SELECT k, avg(v) AS m, stddev_samp(v) AS s FROM cells WHERE is_context GROUP BY k),
z AS (SELECT row_id, any_value(y) AS y, any_value(is_context) AS is_context, list(least(greatest((v - m) / (s + 1e-8), -100), 100) ORDER BY k) AS z FROM cells JOIN stats USING (k) GROUP BY row_id),
pairs AS (SELECT q.row_id, q.y AS y_true, c.y, list_dot_product(q.z, c.z) / sqrt(len(q.z)) AS s FROM z q JOIN z c ON NOT q.is_context AND c.is_context),
top AS (SELECT row_id, max(s) AS top FROM pairs GROUP BY row_id),
votes AS (SELECT row_id, any_value(y_true) AS y_true, y, sum(exp(s - top)) AS e FROM pairs JOIN top USING (row_id) GROUP BY row_id, y),
classes AS (SELECT CAST(unnest(range(0, (SELECT max(y) + 1 FROM emb WHERE is_context))) AS INTEGER) AS class),
proba AS (SELECT q.row_id, q.y AS y_true, class, coalesce(e, 0) / (SELECT sum(e) FROM votes v WHERE v.row_id = q.row_id) AS p
       FROM z q CROSS JOIN classes LEFT JOIN votes v ON v.row_id = q.row_id AND v.y = class WHERE NOT q.is_context),
pred AS (SELECT row_id, y_true, class AS y_pred FROM proba QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) = 1)"""


def document_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_docs: row_id, n_chars, n_words, uniq_ratio, lang, source, quality, toxic, is_context."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\t-\r ]+"), lambda x: x != "")
    d = d.select("doc_id", "n_chars", "lang", "source", "quality", "toxic", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_unique"))
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.col("n_words"))
    return d.select(F.col("doc_id").alias("row_id"), "n_chars", "n_words", ratio.alias("uniq_ratio"), "lang", "source", "quality", "toxic", (F.col("doc_id") % 2 == 0).alias("is_context"))


DOCUMENTS_SQL = """
words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '') AS w, n_chars, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)),
docs AS (SELECT doc_id AS row_id, n_chars, len(w) AS n_words, CAST(len(list_distinct(w)) AS DOUBLE) / nullif(len(w), 0) AS uniq_ratio, lang, source, quality, toxic, doc_id % 2 = 0 AS is_context FROM words)"""


def order_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_orders: row_id, o_custkey, o_orderpriority, o_month, price, status, fold, is_context."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderpriority", F.month("o_orderdate").alias("o_month"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderkey") % 5 != 0).alias("is_context"))


ORDERS_SQL = """
ords AS (SELECT o_orderkey AS row_id, o_custkey, o_orderpriority, month(o_orderdate) AS o_month, o_totalprice AS price, o_orderstatus AS status, o_orderkey % 5 AS fold, o_orderkey % 5 <> 0 AS is_context FROM orders)"""

MIXED_COLUMNS = ["num_null", "num_str", "cat_null", "const", "empty", "mostly_num", "cat_unseen"]


def mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_mixed: columns for every case of the preprocessor; training rows have even row_id."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("row_id"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("num_null"),
        F.when(k % 11 != 0, F.col("o_custkey").cast("string")).alias("num_str"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("cat_null"),
        F.lit("k").alias("const"),
        F.lit(None).cast("string").alias("empty"),
        F.when(k % 101 == 0, "n/a").otherwise((k % 10).cast("string")).alias("mostly_num"),
        F.when((k % 2 == 1) & (k % 17 == 3), "new").otherwise(F.col("o_orderstatus")).alias("cat_unseen"),
    )


MIXED_SQL = """
mixed AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS num_null,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS num_str, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS cat_null,
       'k' AS "const", CAST(NULL AS VARCHAR) AS "empty", CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS mostly_num,
       CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 17 = 3 THEN 'new' ELSE o_orderstatus END AS cat_unseen FROM orders)"""


def task_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tasks: a row per task, its sizes counted from its table."""
    emb, docs, orders = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "labels"), read(spark, sf_dir, "orders")
    parts = [(1, "classification", "emb", "label", 64, emb), (2, "classification", "emb_binary", "label >= 5", 64, emb), (3, "classification", "docs_quality", "quality", 5, docs), (4, "classification", "docs_toxic", "toxic", 5, docs), (5, "classification", "orders_status", "o_orderstatus", 3, orders), (6, "regression", "orders_price", "o_totalprice", 3, orders)]
    out = None
    for no, kind, name, target, width, table in parts:
        row = table.agg(F.count("*").alias("n_samples")).select(F.lit(no).alias("task_id"), F.lit(kind).alias("task_type"), F.lit(name).alias("dataset_name"), F.lit(target).alias("target"), F.lit(width).alias("n_features"), "n_samples")
        out = row if out is None else out.unionByName(row)
    return out


TASKS_SQL = """
tasks AS (SELECT 1 AS task_id, 'classification' AS task_type, 'emb' AS dataset_name, 'label' AS target, 64 AS n_features, (SELECT count(*) FROM embeddings) AS n_samples
       UNION ALL SELECT 2, 'classification', 'emb_binary', 'label >= 5', 64, (SELECT count(*) FROM embeddings) UNION ALL SELECT 3, 'classification', 'docs_quality', 'quality', 5, (SELECT count(*) FROM labels)
       UNION ALL SELECT 4, 'classification', 'docs_toxic', 'toxic', 5, (SELECT count(*) FROM labels) UNION ALL SELECT 5, 'classification', 'orders_status', 'o_orderstatus', 3, (SELECT count(*) FROM orders)
       UNION ALL SELECT 6, 'regression', 'orders_price', 'o_totalprice', 3, (SELECT count(*) FROM orders))"""


def order_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """splits of the orders' tasks (5 and 6), five folds: task_id, fold, repeat, row_id, is_train."""
    o = order_task(spark, sf_dir).select("row_id", F.col("fold").alias("own"))
    d = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).select("*", F.explode(F.array(F.lit(5), F.lit(6))).alias("task_id"))
    return d.select("task_id", "fold", F.lit(0).alias("repeat"), "row_id", (F.col("own") != F.col("fold")).alias("is_train"))

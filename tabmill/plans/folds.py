"""Many tasks and folds as one grouped job: preprocessors fitted for every (task, fold) in two aggregations over long cells, all
folds transformed by one projection and answered as one collection of tables.

The plan grows with the tasks, whose tables have columns of their own, not with the folds; the number of jobs grows with neither.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.functions.arrays import argmax
from tabmill.operators.attention import MAX_CONTEXT, attention_scorer, score_collection
from tabmill.operators.normalize import EPSILON
from tabmill.operators.preprocess import as_number, present
from tabmill.sources.storage import written


@dataclass(frozen=True)
class FoldedTask:
    """One table with a target. table: row_id, feature columns, y."""

    name: str
    task_type: str
    table: DataFrame
    columns: list[str]


def long_rows(tasks: list[FoldedTask]) -> DataFrame:
    """task_no, dataset, row_id, y and cells (by column: its value as text, and as a number) of all tasks."""
    parts = []
    for no, t in enumerate(tasks):
        dated = [dict(t.table.dtypes)[c].startswith(("timestamp", "date")) for c in t.columns]
        cell = lambda c, is_date, t=t: F.struct(present(t.table, c).cast("string").alias("v"), (F.lit(None).cast("double") if is_date else as_number(t.table, c)).alias("n"))
        cells = F.array(*(cell(c, d) for c, d in zip(t.columns, dated, strict=True)))
        parts.append(t.table.select(F.lit(no).cast("long").alias("task_no"), F.lit(t.name).alias("dataset"), F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("double").alias("y"), cells.alias("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_all(rows: DataFrame, max_categories: int = 10_000) -> DataFrame:
    """group, columns: what a preprocessor of each group's training rows knows of each column: kind, mean, categories in order, the
    code that fills, and whether values were missing. rows: group, is_train, cells.

    Numbers are aggregated by (group, column). Categories are counted by (group, column, value), for columns that aren't numeric
    or constant; too many are an error, found from a sketch in the first aggregation before values are shuffled.
    """
    cells = rows.where("is_train").select("group", F.posexplode("cells").alias("at", "c")).select("group", "at", "c.v", "c.n")
    facts = cells.groupBy("group", "at").agg(
        F.count("*").alias("rows"), F.count("v").alias("present"), F.count("n").alias("numbers"), F.min("v").eqNullSafe(F.max("v")).alias("constant"), F.avg("n").alias("mean"), F.approx_count_distinct("v", 0.05).alias("about")
    )
    kind = F.when(F.col("constant"), "dropped").when(F.col("present") == F.col("numbers"), "numeric").otherwise("categorical")
    facts = written(facts.withColumn("kind", kind), "columns")
    too_many = facts.where((F.col("kind") == "categorical") & (F.col("about") > 1.5 * max_categories + 10)).count()
    counts = written(cells.join(facts.where("kind = 'categorical'").select("group", "at"), ["group", "at"]).where("v is not null").groupBy("group", "at", "v").agg(F.count("*").alias("n")), "categories") if not too_many else None
    if too_many or counts.groupBy("group", "at").count().where(F.col("count") > max_categories).count():
        raise ValueError(f"more than {max_categories} categories")
    # bounded by max_categories, so a list
    by = counts.groupBy("group", "at").agg(F.array_sort(F.collect_list("v")).alias("values"), F.max("n").alias("most"))
    often = counts.join(by.select("group", "at", "most"), ["group", "at"]).where("n = most").groupBy("group", "at").agg(F.min("v").alias("fill"))
    by = by.join(often, ["group", "at"]).select("group", "at", "values", (F.array_position("values", F.col("fill")) - 1).cast("double").alias("fill"))
    every = facts.join(by, ["group", "at"], "left")
    column = F.struct("at", "kind", "mean", "values", "fill", (F.col("present") < F.col("rows")).alias("missing"))
    return every.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", column.alias("of")))).alias("c")).select("group", F.col("c.of").alias("columns"))


def features(cells: Column, columns: Column) -> Column:
    """x of a row: numeric columns, their indicators, categorical columns, their indicators."""

    def made(c: Column, of: Column) -> Column:
        code = F.array_position(of["values"], c["v"])
        number = F.when(of["kind"] == "numeric", c["n"]).otherwise(F.when(code > 0, (code - 1).cast("double")))
        return F.struct(of["kind"].alias("kind"), of["missing"].alias("missing"), F.coalesce(number, F.when(of["kind"] == "numeric", of["mean"]).otherwise(of["fill"])).alias("x"), number.isNull().cast("double").alias("gone"))

    def blocks(m: Column) -> Column:
        part = lambda kind: F.filter(m, lambda c: c["kind"] == kind)
        gone = lambda kind: F.transform(F.filter(m, lambda c: (c["kind"] == kind) & c["missing"]), lambda c: c["gone"])
        return F.concat(*(a for kind in ("numeric", "categorical") for a in (F.transform(part(kind), lambda c: c["x"]), gone(kind))))

    return F.get(F.transform(F.array(F.zip_with(cells, columns, made)), blocks), F.lit(0))


def predict_folds(tasks: list[FoldedTask], splits: DataFrame, max_context: int = MAX_CONTEXT, max_categories: int = 10_000) -> DataFrame:
    """Predictions (dataset, fold, row_id, y_true, y_pred, proba) of every fold's test rows, by attention over its training rows.

    splits: dataset, fold, row_id, is_train; a row may be in any number of folds. A group of context rows beyond max_context is
    streamed, as score_collection() says.
    """
    if not tasks:
        raise ValueError("no tasks")
    rows = long_rows(tasks).join(splits.select("dataset", F.col("fold").cast("int").alias("fold"), F.col("row_id").cast("long").alias("row_id"), "is_train"), ["dataset", "row_id"])
    rows = written(rows.withColumn("group", F.col("task_no") * F.lit(1 << 32) + F.col("fold")), "folds")
    model = fit_all(rows, max_categories)
    known = F.when(F.col("is_train"), F.col("y"))
    sizes = rows.groupBy("group").agg(F.avg(known).alias("mean"), F.stddev_samp(known).alias("std"), (F.max(known) + 1).cast("int").alias("n_classes"))
    d = rows.join(model, "group").select("group", "dataset", "fold", "task_no", "row_id", "y", "is_train", features(F.col("cells"), F.col("columns")).alias("x"))
    sizes = written(sizes.withColumn("std", F.coalesce("std", F.lit(0.0)) + EPSILON), "targets")
    names = rows.where("not is_train").select("group", "dataset", "fold", "row_id", F.col("y").alias("y_true"))
    out = None
    for kind in ("classification", "regression"):
        own = [no for no, t in enumerate(tasks) if t.task_type == kind]
        if not own:
            continue
        part = d.where(F.col("task_no").isin(*own)).select(F.col("group").alias("dataset_id"), F.col("row_id").alias("row_idx"), "x", "y", F.col("is_train").alias("is_context"))
        if kind == "regression":
            scale = sizes.select(F.col("group").alias("dataset_id"), "mean", "std")
            part = part.join(scale, "dataset_id").withColumn("y", (F.col("y") - F.col("mean")) / F.col("std")).drop("mean", "std")
            scorer = attention_scorer(None)
        else:
            most = sizes.where(F.shiftright("group", 32).isin(*own)).agg(F.max("n_classes")).first()[0]
            scorer = attention_scorer(most or 1)
        got = score_collection(part, scorer, max_context=max_context).select(F.col("dataset_id").alias("group"), F.col("row_idx").alias("row_id"), "output")
        got = got.join(sizes, "group").join(names, ["group", "row_id"])
        proba = F.slice("output", F.lit(1), F.col("n_classes")) if kind == "classification" else F.lit(None).cast("array<double>")
        got = got.withColumn("proba", proba)
        y_pred = argmax(F.col("proba")).cast("double") if kind == "classification" else F.get("output", F.lit(0)) * F.col("std") + F.col("mean")
        got = got.select("dataset", "fold", "row_id", "y_true", y_pred.alias("y_pred"), "proba")
        out = got if out is None else out.unionByName(got)
    return out

"""Feature preprocessing: types inferred on the training rows, imputation, indicators, ordinal codes, assembly.

A column is dropped if it has one distinct value at most, numeric if all its values state numbers, else categorical. Numbers
that are missing get the training mean, categories the most frequent training code (the smallest of equals); a column that
had missing values at fit gets an indicator. A category not seen at fit counts as missing. The features' order is: numeric
columns, their indicators, categorical columns, their indicators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.functions.numbers import to_number
from tabmill.operators.ranking import global_rank
from tabmill.sources.storage import written


def present(df: DataFrame, name: str) -> Column:
    """A column with NaN as null."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if dict(df.dtypes)[name] in ("double", "float") else c


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_present, n_distinct, n_numeric, kind: one aggregation over all columns."""
    aggs = []
    for k, c in enumerate(columns):
        v = present(df, c)
        number = F.lit(None).cast("double") if dict(df.dtypes)[c].startswith(("timestamp", "date")) else as_number(df, c)
        aggs += [F.count(v).alias(f"p{k}"), F.count_distinct(v).alias(f"d{k}"), F.count(number).alias(f"n{k}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"p{k}").alias("n_present"), F.col(f"d{k}").alias("n_distinct"), F.col(f"n{k}").alias("n_numeric")) for k, c in enumerate(columns)))
    kind = F.when(F.col("n_distinct") <= 1, "dropped").when(F.col("n_present") == F.col("n_numeric"), "numeric").otherwise("categorical")
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("kind", kind)


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_rows, n_present, kind, about_distinct: as column_profile(), but a column is constant if its least and largest
    values agree, and distinct values are estimated (5 %), so that one pass without distinct counts will do."""
    aggs = [F.count("*").alias("rows")]
    for k, c in enumerate(columns):
        v = present(df, c)
        number = F.lit(None).cast("double") if dict(df.dtypes)[c].startswith(("timestamp", "date")) else as_number(df, c)
        aggs += [F.count(v).alias(f"p{k}"), F.min(v).eqNullSafe(F.max(v)).alias(f"c{k}"), F.count(number).alias(f"n{k}"), F.approx_count_distinct(v, 0.05).alias(f"a{k}")]
    kind = lambda k: F.when(F.col(f"c{k}"), "dropped").when(F.col(f"p{k}") == F.col(f"n{k}"), "numeric").otherwise("categorical")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows").alias("n_rows"), F.col(f"p{k}").alias("n_present"), kind(k).alias("kind"), F.col(f"a{k}").alias("about_distinct")) for k, c in enumerate(columns)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def as_number(df: DataFrame, name: str) -> Column:
    """A column's numbers; true and false are 1 and 0."""
    v = present(df, name)
    return to_number(v.cast("int") if dict(df.dtypes)[name] == "boolean" else v)


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: how often each column has each value. Counted in each task first."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns)))
    return df.select(values.alias("v")).select("v.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def coded(counts: DataFrame) -> DataFrame:
    """counts with code: a value's place among its column's, in byte order, from 0. The order is found in ranges of all columns'
    values, so a column with most of them is not one task's."""
    ranked = global_rank(counts, ["column", "value"], "_rank")
    first = ranked.groupBy(F.col("column").alias("_c")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col("column") == F.col("_c")).withColumn("code", (F.col("_rank") - F.col("_first")).cast("double")).drop("_c", "_first", "_rank")


def ordinal_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, code, n: each column's distinct values in byte order, from 0."""
    return coded(category_counts(df, columns))


def most_frequent(codes: DataFrame) -> DataFrame:
    """column, code: the most frequent one, the smallest of equals. Each task keeps one of a column."""
    return codes.groupBy("column").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))


@dataclass(frozen=True)
class PreprocessorModel:
    """What was fitted: means by numeric column, codes and fill by categorical column, and which had missing values.

    transform() is a projection, so it works on streams as well.
    """

    means: dict[str, float]
    numeric_missing: list[str]
    codes: dict[str, dict[str, float]]
    fill: dict[str, float]
    categorical_missing: list[str]
    dropped: list[str] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [*self.means, *(f"{c}_missing" for c in self.numeric_missing), *self.codes, *(f"{c}_missing" for c in self.categorical_missing)]

    def features(self, df: DataFrame) -> list[Column]:
        number = {c: as_number(df, c) for c in self.means}
        code = {c: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))[present(df, c).cast("string")] for c, m in self.codes.items()}
        out = [F.coalesce(v, F.lit(self.means[c])) for c, v in number.items()]
        out += [number[c].isNull().cast("double") for c in self.numeric_missing]
        out += [F.coalesce(v, F.lit(self.fill[c])) for c, v in code.items()]
        out += [code[c].isNull().cast("double") for c in self.categorical_missing]
        return out

    def transform(self, df: DataFrame, name: str = "x") -> DataFrame:
        """df with the assembled features."""
        return df.withColumn(name, F.array(*self.features(df)).cast("array<double>"))


class TablePreprocessor:
    """Fits a PreprocessorModel. max_categories bounds what a model holds of a column; more is an error, never a cut."""

    def __init__(self, columns: list[str], max_categories: int = 10_000):
        self.columns, self.max_categories = columns, max_categories

    def fit(self, df: DataFrame) -> PreprocessorModel:
        facts = {r.column: r for r in column_kinds(df, self.columns).collect()}
        kind = {c: facts[c].kind for c in self.columns}
        numeric = [c for c in self.columns if kind[c] == "numeric"]
        categorical = [c for c in self.columns if kind[c] == "categorical"]
        means = df.agg(*(F.avg(as_number(df, c)).alias(f"m{k}") for k, c in enumerate(numeric))).first() if numeric else []
        codes: dict[str, dict[str, float]] = {c: {} for c in categorical}
        fill: dict[str, float] = {}
        # far too many categories are known from the first pass, before any value is shuffled; the rest from counts, before any sort
        if wide := [c for c in categorical if facts[c].about_distinct > 1.5 * self.max_categories + 10]:
            raise ValueError(f"more than {self.max_categories} categories: {', '.join(wide)}")
        if categorical:
            counts = written(category_counts(df, categorical), "categories")
            wide = counts.groupBy("column").count().where(F.col("count") > self.max_categories).collect()
            if wide:
                raise ValueError(f"more than {self.max_categories} categories: {', '.join(r.column for r in wide)}")
            table = coded(counts)
            for r in table.orderBy("column", "code").collect():
                codes[r.column][r.value] = r.code
            fill = {r.column: r.code for r in most_frequent(table).collect()}
        short = lambda cs: [c for c in cs if facts[c].n_present < facts[c].n_rows]
        return PreprocessorModel(dict(zip(numeric, means, strict=True)), short(numeric), codes, fill, short(categorical), [c for c in self.columns if kind[c] == "dropped"])


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """value, y: the labels in order, from 0. One row per class, however many there are."""
    values = df.select(F.col(label).alias("value")).where("value is not null").distinct()
    return global_rank(values, ["value"], "y").select("value", F.col("y").cast("int").alias("y"))


def encode_labels(df: DataFrame, label: str, codes: DataFrame, name: str = "y") -> DataFrame:
    """df with the labels' codes; a label that wasn't seen at fit is an error when its row is computed.

    No broadcast is asked for: Spark decides by the codes' size.
    """
    d = df.join(codes.select(F.col("value").alias("_value"), F.col("y").alias("_y")), F.col(label) == F.col("_value"), "left")
    unseen = F.raise_error(F.concat(F.lit("label not seen at fit: "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    return d.withColumn(name, F.when(F.col("_y").isNotNull(), F.col("_y")).otherwise(unseen.cast("int"))).drop("_value", "_y")


def class_count(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg((F.max(y) + 1).alias("n_classes"))

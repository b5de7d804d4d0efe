"""Synthetic tables. Every draw is seeded by (seed, table, ...), so a table is the same however tables are dealt to tasks.

A generator takes `tables` (dataset_id and sizes, see draw_sizes()) and returns rows. Two kinds are native: hashed draws per
cell. The others run numpy per table inside mapInPandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabmill.functions.numbers import uniform
from tabmill.sources.collections import ROWS


@dataclass(frozen=True)
class MlpPrior:
    """Tables from random networks over uniform inputs."""

    layers: int = 2
    hidden: int = 64
    noise: float = 0.05
    init_std: float = 1.0
    relu: bool = False
    rotate: bool = True


@dataclass(frozen=True)
class GpPrior:
    """Tables from a Gaussian process over uniform inputs."""

    noise: float = 1e-3
    outputscale: float = 3.0
    lengthscale: float = 1.0
    by_features: bool = False


#: The named settings: first and second family of networks and processes.
MLP_A, GP_A = MlpPrior(), GpPrior()
MLP_B, GP_B = replace(MLP_A, noise=0.1, relu=True, rotate=False), GpPrior(noise=0.1, outputscale=1.0, lengthscale=0.2, by_features=True)
#: Weights of a bag's processes and networks; a softmax of them gives their shares.
BAG = (1.0, 2.0)


def draw_sizes(tables: DataFrame, seed: int, rows: tuple[int, int], features: tuple[int, int], min_split: int = 1) -> DataFrame:
    """tables with n_rows, n_features, split_index: whole numbers drawn evenly within bounds (inclusive)."""
    draw = lambda name, low, high: (low + F.floor(uniform(seed, name, F.col("dataset_id")) * (high - low + 1))).cast("int")
    d = tables.withColumn("n_rows", draw("rows", F.lit(rows[0]), F.lit(rows[1]))).withColumn("n_features", draw("features", F.lit(features[0]), F.lit(features[1])))
    return d.withColumn("split_index", draw("split", F.lit(min_split), F.greatest(F.col("n_rows") - 1, F.lit(min_split))))


def mlp_table(p: MlpPrior, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    h = x @ np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0] if p.rotate else x
    for k in range(p.layers):
        wide = 1 if k == p.layers - 1 else p.hidden
        h = h @ rng.normal(0, p.init_std / np.sqrt(h.shape[1]), (h.shape[1], wide))
        if k < p.layers - 1:
            h = np.maximum(h, 0) if p.relu else np.tanh(h)
        h = h + rng.normal(0, p.noise, h.shape)
    return h[:, 0]


def gp_table(p: GpPrior, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    if p.by_features:
        gap = gap / x.shape[1]
    k = p.outputscale * np.exp(-gap / (2 * p.lengthscale**2)) + (p.noise + 1e-8) * np.eye(len(x))
    return np.linalg.cholesky(k) @ rng.normal(size=len(x))


def _numpy_tables(tables: DataFrame, seed: int, target: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t in pdf.itertuples():
                rng = np.random.default_rng([seed, t.dataset_id % 2**63])
                x = rng.random((t.n_rows, t.n_features))
                yield pd.DataFrame({"dataset_id": t.dataset_id, "row_idx": np.arange(t.n_rows, dtype=np.int32), "x": list(x), "y": target(x, rng)})

    return tables.select("dataset_id", "n_rows", "n_features").mapInPandas(run, ROWS)


def mlp(tables: DataFrame, seed: int, prior: MlpPrior = MLP_A) -> DataFrame:
    return _numpy_tables(tables, seed, lambda x, rng: mlp_table(prior, x, rng))


def gp(tables: DataFrame, seed: int, prior: GpPrior = GP_A) -> DataFrame:
    return _numpy_tables(tables, seed, lambda x, rng: gp_table(prior, x, rng))


def is_mlp_in_bag(tables: DataFrame, seed: int, weights: tuple[float, float] = BAG) -> DataFrame:
    """tables with is_mlp, drawn by the softmax of the weights."""
    share = float(np.exp(weights[1]) / np.exp(np.array(weights)).sum())
    return tables.withColumn("is_mlp", uniform(seed, "bag", F.col("dataset_id")) < share)


def bag(tables: DataFrame, seed: int, gp_prior: GpPrior = GP_B, mlp_prior: MlpPrior = MLP_B) -> DataFrame:
    chosen = is_mlp_in_bag(tables, seed)
    return mlp(chosen.where("is_mlp"), seed, mlp_prior).unionByName(gp(chosen.where("not is_mlp"), seed, gp_prior))


def cells(tables: DataFrame, seed: int) -> DataFrame:
    """dataset_id, row_idx, x: uniform features, drawn natively by cell."""
    d = tables.select("dataset_id", "n_features", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx"))
    x = F.transform(F.sequence(F.lit(0), F.col("n_features") - 1), lambda k: uniform(seed, "x", F.col("dataset_id"), F.col("row_idx"), k))
    return d.select("dataset_id", "row_idx", x.alias("x"), "n_features")


def step_function(tables: DataFrame, seed: int, max_steps: int = 1) -> DataFrame:
    """y is the number of thresholds that one feature of the row passes; both are drawn by table, 1 to max_steps of them."""
    d = cells(tables, seed)
    feature = F.floor(uniform(seed, "feature", F.col("dataset_id")) * F.col("n_features")).cast("int")
    steps = (1 + F.floor(uniform(seed, "steps", F.col("dataset_id")) * max_steps)).cast("int")
    passed = F.filter(F.sequence(F.lit(1), steps), lambda k: F.get("x", feature) > uniform(seed, "threshold", F.col("dataset_id"), k))
    return d.select("dataset_id", "row_idx", "x", F.size(passed).cast("double").alias("y"))


def boolean_conjunctions(tables: DataFrame, seed: int, max_rank: int = 20, p_uninformative: float = 0.3, max_fraction_uninformative: float = 0.3) -> DataFrame:
    """Features are 0 or 1; y is 1 if any of a table's conjunctions holds. A conjunction names one to three of the informative
    features and the value each must have; with probability p_uninformative some features, up to the fraction, are in none."""
    d = cells(tables, seed)
    ds = F.col("dataset_id")
    rank = (1 + F.floor(uniform(seed, "rank", ds) * max_rank)).cast("int")
    useless = F.when(uniform(seed, "useless", ds) < p_uninformative, F.floor(uniform(seed, "how many", ds) * (F.col("n_features") * max_fraction_uninformative + 1))).otherwise(0)
    d = d.select("dataset_id", "row_idx", F.transform("x", lambda v: F.when(v < 0.5, 0.0).otherwise(1.0)).alias("x"), F.greatest(F.col("n_features") - useless, F.lit(1)).alias("usable"), rank.alias("rank"))

    def holds(k):
        literals = F.sequence(F.lit(1), (1 + F.floor(uniform(seed, "length", ds, k) * 3)).cast("int"))
        want = lambda j: F.when(uniform(seed, "value", ds, k, j) < 0.5, 0.0).otherwise(1.0)
        return F.forall(literals, lambda j: F.get("x", F.floor(uniform(seed, "literal", ds, k, j) * F.col("usable")).cast("int")) == want(j))

    return d.select("dataset_id", "row_idx", "x", F.exists(F.sequence(F.lit(1), F.col("rank")), holds).cast("double").alias("y"))


def class_counts(tables: DataFrame, seed: int, max_classes: int) -> DataFrame:
    """tables with n_classes: two with probability one half, else evenly from 2 to max_classes."""
    ds = F.col("dataset_id")
    more = 2 + F.floor(uniform(seed, "classes", ds) * (max_classes - 1))
    return tables.withColumn("n_classes", F.when(uniform(seed, "two", ds) < 0.5, 2).otherwise(more).cast("int"))


def classes_by_rank(rows: DataFrame, counts: DataFrame, seed: int, balanced: bool = False) -> DataFrame:
    """rows with y as a class: how many boundaries lie below it. Boundaries are values of the table at drawn ranks (balanced: of
    equal parts). counts: dataset_id, n_classes."""
    d = rows.join(counts.select("dataset_id", "n_classes"), "dataset_id")
    w = Window.partitionBy("dataset_id").orderBy("y", "row_idx")
    d = d.withColumn("_rank", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("dataset_id")))
    if balanced:
        y = F.floor((F.col("_rank") - 1) * F.col("n_classes") / F.col("_n"))
        return d.withColumn("y", y.cast("double")).drop("_rank", "_n", "n_classes")
    at = F.transform(F.sequence(F.lit(1), F.col("n_classes") - 1), lambda k: 1 + F.floor(uniform(seed, "boundary", F.col("dataset_id"), k) * F.col("_n")))
    cut = d.withColumn("_at", at).groupBy("dataset_id").agg(F.collect_list(F.when(F.array_contains("_at", F.col("_rank").cast("long")), F.struct("_rank", "y", F.size(F.filter("_at", lambda a: a == F.col("_rank"))).alias("times")))).alias("_cuts"))
    d = d.join(cut, "dataset_id")
    y = F.aggregate(F.filter("_cuts", lambda c: c.y < F.col("y")), F.lit(0), lambda s, c: s + c.times)
    return d.withColumn("y", y.cast("double")).drop("_rank", "_n", "_cuts", "n_classes")


def shuffle_classes(rows: DataFrame, counts: DataFrame, seed: int, ordered_share: float = 0.1) -> DataFrame:
    """rows with classes renamed by a drawn permutation of their table, but for a share of tables whose order stays."""
    ds = F.col("dataset_id")
    d = rows.join(counts.select("dataset_id", "n_classes"), "dataset_id")
    places = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n_classes") - 1), lambda k: F.struct(uniform(seed, "order", ds, k).alias("u"), k.alias("k")))), lambda s: s.k)
    new = F.when(uniform(seed, "ordered", ds) < ordered_share, F.col("y")).otherwise(F.get(places, F.col("y").cast("int")).cast("double"))
    return d.withColumn("y", new).drop("n_classes")


def categorical_features(rows: DataFrame, seed: int, share: float = 0.15, levels: int = 5) -> DataFrame:
    """rows with a drawn share of (table, feature) made categorical: equal parts of the table's own order, as 0, 1, ..."""
    ds = F.col("dataset_id")
    # cells of chosen features alone are ranked; the others stay where they are
    cells = F.filter(F.transform("x", lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda c: uniform(seed, "categorical", ds, c.k) < share)
    long = rows.select("dataset_id", "row_idx", F.explode(cells).alias("c")).select("dataset_id", "row_idx", "c.k", "c.v")
    w = Window.partitionBy("dataset_id", "k").orderBy("v", "row_idx")
    long = long.withColumn("level", (F.ntile(levels).over(w) - 1).cast("double"))
    own = long.groupBy("dataset_id", "row_idx").agg(F.collect_list(F.struct("k", "level")).alias("_levels"))
    d = rows.join(own, ["dataset_id", "row_idx"], "left")
    new = lambda v, k: F.coalesce(F.get(F.filter("_levels", lambda c: c.k == k), F.lit(0)).level, v)
    return d.select("dataset_id", "row_idx", F.when(F.col("_levels").isNull(), F.col("x")).otherwise(F.transform("x", new)).alias("x"), "y")


def missing_values(rows: DataFrame, seed: int, p: float = 0.05, p_reason: float = 0.03, p_set: float = 0.9) -> DataFrame:
    """rows with missing features: at random with p; and, in a share p_reason of (table, feature), of values above one half."""
    ds, row = F.col("dataset_id"), F.col("row_idx")

    def cell(v, k):
        at_random = uniform(seed, "missing", ds, row, k) < p
        reason = (uniform(seed, "reason", ds, k) < p_reason) & (v > 0.5) & (uniform(seed, "set", ds, row, k) < p_set)
        return F.when(~(at_random | reason), v)

    return rows.withColumn("x", F.transform("x", cell))


def used_features(rows: DataFrame, tables: DataFrame, seed: int) -> DataFrame:
    """rows with the first few features only, how many drawn evenly by table; nothing is padded."""
    used = tables.select("dataset_id", (1 + F.floor(uniform(seed, "used", F.col("dataset_id")) * F.col("n_features"))).cast("int").alias("_used"))
    return rows.join(used, "dataset_id").withColumn("x", F.slice("x", F.lit(1), F.col("_used"))).drop("_used")


def as_classification(rows: DataFrame, tables: DataFrame, seed: int, max_classes: int) -> DataFrame:
    """The classification adapter: a drawn class count, classes by rank, permuted, with categorical and missing features."""
    counts = class_counts(tables.select("dataset_id"), seed, max_classes)
    d = shuffle_classes(classes_by_rank(rows, counts, seed), counts, seed)
    return missing_values(categorical_features(d, seed), seed)


PRIORS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "mlp": mlp, "gp": gp, "step_function": step_function, "boolean_conjunctions": boolean_conjunctions, "prior_bag": bag,
    "mlp_b": lambda t, s: mlp(t, s, MLP_B), "gp_b": lambda t, s: gp(t, s, GP_B),
}


def generate_collection(tables: DataFrame, prior: str, seed: int, max_classes: int = 0) -> tuple[DataFrame, str]:
    """rows and the problem type: regression if max_classes is 0, else classification by the adapter."""
    if prior not in PRIORS:
        raise ValueError(f"unknown prior {prior!r}; one of {', '.join(PRIORS)}")
    rows = PRIORS[prior](tables, seed)
    if prior in ("step_function", "boolean_conjunctions"):
        return rows, "classification"
    return (as_classification(rows, tables, seed, max_classes), "classification") if max_classes else (rows, "regression")

"""Scaling by context rows alone, and buckets of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.functions.arrays import clip
from tabmill.operators.ranking import values_at
from tabmill.sources.storage import written

#: Added to a standard deviation before it divides.
EPSILON = 1e-8
#: Decimals of scaled targets that are put into buckets: equal ones stay equal, in whatever order their table's sums were added.
DECIMALS = 9
#: A value this little below an edge lies at it: edges come from rounded values, so they are off by up to half of the last decimal.
#: Under that half, so that values which are rounded themselves are on the side that they were rounded to.
SLACK = 0.49 * 10.0**-DECIMALS
#: Most targets that bucket edges are drawn from.
MAX_Y = 5_000_000


def context_stats(rows: DataFrame, width: int) -> DataFrame:
    """dataset_id, mean, std (arrays by feature): of the context rows, one aggregation, no explosion of features.

    rows: dataset_id, x, is_context. A single context row has a null std.
    """
    x = [F.when(F.col("is_context"), F.get("x", F.lit(k))) for k in range(width)]
    return rows.groupBy("dataset_id").agg(F.array(*(F.avg(c) for c in x)).alias("mean"), F.array(*(F.stddev_samp(c) for c in x)).alias("std"))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + EPSILON)


def normalize_features(rows: DataFrame, width: int, bound: float | None = 100.0) -> DataFrame:
    """rows with x scaled by its table's context rows, and clipped unless bound is None."""
    both = rows.join(context_stats(rows, width), "dataset_id")
    z = F.transform(F.arrays_zip("x", "mean", "std"), lambda t: zscore(t["x"], t["mean"], t["std"]) if bound is None else clip(zscore(t["x"], t["mean"], t["std"]), bound))
    return both.withColumn("x", z).drop("mean", "std")


def normalize_targets(rows: DataFrame, name: str = "y_norm") -> DataFrame:
    """rows with the target scaled by its table's context targets (context and query rows alike)."""
    y = F.when(F.col("is_context"), F.col("y"))
    stats = rows.groupBy("dataset_id").agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"))
    return rows.join(stats, "dataset_id").withColumn(name, zscore(F.col("y"), F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def fill_targets(rows: DataFrame, name: str = "y_known") -> DataFrame:
    """rows with the target of query rows replaced by the mean of their table's context targets."""
    known = F.when(F.col("is_context"), F.col("y"))
    stats = rows.groupBy("dataset_id").agg(F.avg(known).alias("_mean"))
    return rows.join(stats, "dataset_id").withColumn(name, F.when(F.col("is_context"), F.col("y")).otherwise(F.col("_mean"))).drop("_mean")


def fit_target_scaler(df: DataFrame, y: str = "y") -> tuple[float, float]:
    """Mean and standard deviation (with EPSILON), to scale with and back."""
    r = df.agg(F.avg(y), F.stddev_samp(y)).first()
    return r[0], (r[1] or 0.0) + EPSILON


def scaled_targets(rows: DataFrame, name: str = "z") -> DataFrame:
    """rows with the target scaled by its whole table, to DECIMALS: what is put into buckets, and what their edges come from."""
    stats = rows.groupBy("dataset_id").agg(F.avg("y").alias("_mean"), F.stddev_samp("y").alias("_std"))
    return rows.join(stats, "dataset_id").withColumn(name, F.round(zscore(F.col("y"), F.col("_mean"), F.col("_std")), DECIMALS)).drop("_mean", "_std")


def bucket_edges(rows: DataFrame, n_buckets: int, max_y: int = MAX_Y) -> DataFrame:
    """bucket, lo, hi: edges that divide the scaled targets of the first tables evenly.

    rows: dataset_id, dataset_pos, row_idx, y. The first max_y // n tables count, n the rows of the longest, each scaled by its
    own mean and deviation, to DECIMALS. What is left over after division by n_buckets is dropped from the end in stored order. An inner
    edge is the middle of the two values beside it, the outer ones are the extremes. The values beside edges are selected, not
    sorted for (values_at()); they alone reach the driver.
    """
    size = rows.groupBy("dataset_pos").agg(F.count("*").alias("n"))
    longest = size.agg(F.max("n")).first()[0] or 1
    used = rows.where(F.col("dataset_pos") < max_y // longest)
    z = written(scaled_targets(used).select("dataset_pos", "row_idx", "z").where("z is not null"), "scaled")
    n = z.count()
    if n < n_buckets:
        raise ValueError(f"{n} targets are too few for {n_buckets} buckets")
    if rest := n % n_buckets:  # fewer rows than buckets: the first of them, from the end, is where the used ones stop
        stop = z.orderBy(F.desc("dataset_pos"), F.desc("row_idx")).limit(rest).agg(F.min(F.struct("dataset_pos", "row_idx")).alias("at")).first()["at"]
        place, row = F.col("dataset_pos"), F.col("row_idx")
        z = z.where((place < stop["dataset_pos"]) | ((place == stop["dataset_pos"]) & (row < stop["row_idx"])))
    m = n // n_buckets
    beside = sorted({0, n - rest - 1} | {k * m - j for k in range(1, n_buckets) for j in (0, 1)})
    at = values_at(z.select("z"), "z", beside)
    edge = [at[0], *((at[k * m - 1] + at[k * m]) / 2 for k in range(1, n_buckets)), at[n - rest - 1]]
    return rows.sparkSession.createDataFrame([(k, edge[k], edge[k + 1]) for k in range(n_buckets)], "bucket int, lo double, hi double")


def bucketize(rows: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """rows with the bucket of value; the last bucket holds its upper edge, outer buckets what lies beyond them. A value at an inner
    edge, or less than SLACK below it, is in the upper bucket.

    edges: bucket_edges(); n_buckets rows, so it is collected and searched inside the projection.
    """
    lo = [r.lo for r in edges.orderBy("bucket").select("lo").collect()]
    inner = F.array(*(F.lit(x - SLACK) for x in lo[1:])) if len(lo) > 1 else F.array().cast("array<double>")
    return rows.withColumn("bucket", F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e <= F.col(value)))))

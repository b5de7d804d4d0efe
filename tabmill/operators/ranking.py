"""Ranks and running totals without a window over all rows, or over all rows of a key: ranges, then offsets by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabmill.functions.arrays import place_in
from tabmill.sources.storage import written

#: Ranges that a column's values are cut into.
RANGES = 256


def global_rank(df: DataFrame, by: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """df with `name`: each row's place, from 0, in the order of `by` (which should decide ties).

    Rows are range-partitioned and sorted there once, into a written table, with their partition and their place in it: the
    bounds of the ranges are sampled, so a second evaluation could deal the rows differently. Partitions' offsets come from
    that table and have one row per partition, which is what is broadcast.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    d = written(d.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return d.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_p", "_offset")


def quantile_bounds(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Values that cut a numeric column into about equally many rows, each once. Sketched in one pass; any would do for what
    follows, so that exact results don't depend on them."""
    # one expression: thousands of literals one by one take seconds to build
    at = ", ".join(f"{k / ranges!r}D" for k in range(1, ranges)) or "0.5D"
    found = df.select(F.col(column).cast("double").alias("v")).agg(F.expr(f"percentile_approx(v, array({at}), {20 * ranges})").alias("b")).first()["b"]
    return sorted({b for b in found or [] if b == b})


def running_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same keys that come before in the order of a numeric column, which
    has each number once a key. Nulls come first, NaN last.

    A key's rows are cut into ranges of the column, at bounds sketched over all rows: sums of ranges are totalled by key (at most
    `ranges` rows each), rows by key and range. So a key that holds most of the rows is dealt over about as many tasks as others.
    """
    at = F.coalesce(place_in(F.col(order).cast("double"), quantile_bounds(df, order, ranges)), F.lit(-1))
    d = df.withColumn("_range", at)
    of_range = d.groupBy(*keys, "_range").agg(F.sum(value).alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = of_range.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(of_range, same).withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_r", "_base", "_own", *(f"_k{i}" for i in range(len(keys))))


def values_at(df: DataFrame, column: str, ranks: list[int], ranges: int = 4096) -> dict[int, float]:
    """The values that have these ranks, from 0, in the order of a numeric column without nulls: exact, without a sort of all rows.

    A sketch cuts the values into ranges; one pass counts rows by range, which tells the ranges that the ranks fall into; a second
    one collapses and orders the values of those ranges alone. df is read three times: write it beforehand if it is costly.
    """
    if not ranks:
        return {}
    d = df.select(F.col(column).cast("double").alias("v"))
    d = d.withColumn("at", place_in(F.col("v"), quantile_bounds(d, "v", ranges)))
    start, base = 0, {}
    for r in sorted(d.groupBy("at").agg(F.count("*").alias("n")).collect(), key=lambda r: r["at"]):
        base[r["at"]] = (start, start + r["n"])
        start += r["n"]
    wanted = [(cell, k, k - lo) for cell, (lo, hi) in base.items() for k in ranks if lo <= k < hi]
    inside = Window.partitionBy("at").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = d.where(F.col("at").isin(*sorted({c for c, _, _ in wanted}))).groupBy("at", "v").agg(F.count("*").alias("n"))
    own = own.withColumn("lo", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    asked = df.sparkSession.createDataFrame(wanted, "_at int, rank long, inside long")
    hit = (F.col("at") == F.col("_at")) & (F.col("inside") >= F.col("lo")) & (F.col("inside") < F.col("lo") + F.col("n"))
    return {r["rank"]: r["v"] for r in own.join(F.broadcast(asked), hit).select("rank", "v").collect()}

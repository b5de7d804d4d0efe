from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.functions.arrays import place_in
from tabmill.operators import metrics as M
from tabmill.operators import preprocess as P
from tabmill.operators.ranking import running_before, values_at


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16, 100])
def test_place_in(spark, n):
    rng = np.random.default_rng(n)
    bounds = sorted({round(float(v), 1) for v in rng.normal(size=n)})
    x = [None, float("nan"), -math.inf, math.inf, 0.0, *bounds, *(b + 0.01 for b in bounds)]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double")
    got = [r.p for r in d.select("k", place_in(F.col("v"), bounds).alias("p")).orderBy("k").collect()]
    assert got == [None, len(bounds), *(sum(b < v for b in bounds) for v in x[2:])]


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_running_before(spark, ranges):
    rng = np.random.default_rng(5)
    rows = {(k, float(v)): int(w) for k, v, w in zip(rng.choice(["big"] * 8 + ["small", None], 3000).tolist(), rng.normal(size=3000).round(2), rng.integers(0, 9, 3000), strict=True)}
    d = spark.createDataFrame([(k, v, w) for (k, v), w in rows.items()], "k string, v double, w long")
    got = {(r.k, r.v): r.t for r in running_before(d, ["k"], "v", "w", "t", ranges).collect()}
    assert got == {(k, v): sum(w for (j, u), w in rows.items() if j == k and u < v) for k, v in rows}


def test_auc_of_one_large_dataset_is_not_one_tasks(spark):
    n = 400_000
    d = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("dataset"), (F.xxhash64("id") % 5 < 2).alias("positive"), F.round((F.pmod(F.xxhash64(F.col("id") + 1), F.lit(1_000_003)) / 1_000_003) ** 3, 7).alias("score"))
    got = {r.dataset: r.roc_auc for r in M.roc_auc(d, ["dataset"]).collect()}
    pdf = d.toPandas()
    for name, g in pdf.groupby("dataset"):
        rank, p = g["score"].rank().to_numpy(), g["positive"].to_numpy()
        assert got[name] == pytest.approx((rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()), abs=1e-12)
    by = running_before(d.groupBy("dataset", "score").agg(F.count("*").alias("n")), ["dataset"], "score", "n", "t")
    # what one task orders is a range of a dataset, a hundredth or so of its scores
    sizes = by.groupBy("dataset", F.expr("floor(t / 4000)")).count().agg(F.max("count")).first()[0]
    assert sizes <= 4000 and "_range" in plan_of(by)


def test_values_at(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=5000), np.full(3000, 0.25), rng.normal(size=2000).round(1)])
    d = spark.createDataFrame([(float(x),) for x in v], "z double").repartition(5)
    ranks = [0, 1, 17, 2500, 4999, 5000, 6000, 9998, 9999]
    assert values_at(d, "z", ranks) == dict(zip(ranks, np.sort(v)[ranks].tolist(), strict=True))
    assert values_at(d, "z", ranks, 3) == values_at(d, "z", ranks) and values_at(d, "z", []) == {}


def test_categories_beyond_the_limit_fail_before_they_are_shuffled(spark, monkeypatch):
    d = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("c"), F.lit(1.5).alias("y"))
    with monkeypatch.context() as m:
        m.setattr(P, "category_counts", lambda *a: pytest.fail("values were counted"))
        with pytest.raises(ValueError, match="more than 10000 categories: c"):
            P.TablePreprocessor(["c"]).fit(d)
    # just above the limit the exact counts decide
    few = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 101).alias("c"))
    with pytest.raises(ValueError, match="more than 100"):
        P.TablePreprocessor(["c"], max_categories=100).fit(few)
    assert len(P.TablePreprocessor(["c"], max_categories=101).fit(few).codes["c"]) == 101


def test_codes_of_many_values_and_several_columns(spark):
    d = spark.range(60_000).select(F.concat(F.lit("v"), F.col("id") % 50_000).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 7)).alias("b"))
    codes = P.ordinal_codes(d, ["a", "b"])
    # the one window is over the ranges' sizes, a row each
    assert all("[sum(_n#" in line for line in plan_of(codes).splitlines() if "Window [" in line)
    rows = codes.collect()
    for c, values in (("a", {f"v{k}" for k in range(50_000)}), ("b", {f"w{k}" for k in range(7)})):
        assert {r.value: r.code for r in rows if r.column == c} == {v: float(k) for k, v in enumerate(sorted(values))}
    assert {r.column: r.code for r in P.most_frequent(codes).collect()} == {"a": 0.0, "b": 1.0}


def test_edges_of_the_first_tables_are_the_sql(spark, sf):
    from tabmill.operators import normalize as N
    from tabmill.plans import fixtures as X
    from tabmill.plans.queries import ORACLES
    from tests.oracle import connect

    rows = X.event_tables(spark, sf)[0].select("dataset_id", "dataset_pos", "row_idx", F.col("value").alias("y"))
    for most in (N.MAX_Y, 400):
        sql = ORACLES["n6_bucket_edges"]
        assert str(N.MAX_Y) in sql
        want = connect(sf).execute(sql.replace(str(N.MAX_Y), str(most))).fetchall()
        got = [(r.bucket, round(r.lo, 6), round(r.hi, 6)) for r in N.bucket_edges(rows, 10, most).orderBy("bucket").collect()]
        assert got == sorted(want)


def test_equal_targets_fall_into_one_bucket(spark):
    """Copies of a table whose rows come in other orders have other last digits of their means and deviations."""
    from tabmill.operators import normalize as N

    rng = np.random.default_rng(4)
    y = np.round(rng.gamma(1.0, 50.0, 70), 2)
    rows = [(t, t, k, float(v)) for t in range(40) for k, v in enumerate(rng.permutation(y))]
    d = spark.createDataFrame(rows, "dataset_id long, dataset_pos long, row_idx int, y double")
    z = N.bucketize(N.scaled_targets(d), N.bucket_edges(d, 10), "z")
    assert z.groupBy("y").agg(F.count_distinct("z", "bucket").alias("n")).where("n > 1").count() == 0


def test_values_at_an_edge_before_and_after_rounding(spark):
    """Edges are those of rounded values: the middle of two unrounded ones is at the edge, rounded values next to it are not."""
    from tabmill.operators import normalize as N

    def bucket(edges, values):
        e = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bucket int, lo double, hi double")
        d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, z double").coalesce(1)
        return [r.bucket for r in N.bucketize(d, e, "z").orderBy("k").collect()]

    a, b = 0.12345678961, 0.22345678964  # rounded to 0.123456790 and 0.223456790
    edge = (round(a, 9) + round(b, 9)) / 2
    assert (a + b) / 2 < edge
    assert bucket([-1.0, edge, 1.0], [(a + b) / 2, edge, a, b, None]) == [1, 1, 0, 1, None]
    for at in (0.25, -3.1, 1234.5):  # an edge between two neighbouring decimals, and one at a decimal
        for middle, below in ((at + 0.5e-9, at), (at, at - 1e-9)):
            assert bucket([-9.0, middle, 9999.0], [round(below, 9), round(below + 1e-9, 9)]) == [0, 1]

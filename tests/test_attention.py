from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.functions import kernel
from tabmill.operators import attention as A
from tabmill.operators.estimators import InContextClassifier, InContextRegressor
from tabmill.streaming import replay as R


def drawn(spark, n_context, n_query, classes=4, width=3, seed=0):
    """One table, made in Spark: row_id, x, y, target, is_context."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_003)) / 1_000_003.0
    d = spark.range(n_context + n_query, numPartitions=6)
    x = F.array(*(3 * u(k) - k for k in range(width)))
    return d.select(F.col("id").alias("row_id"), x.alias("x"), F.floor(u(99) * classes).cast("int").alias("y"), (u(98) * 5).alias("target"), (F.col("id") < n_context).alias("is_context"))


def plain(d, n_classes):
    rows = d.orderBy("row_id").collect()
    c = [r for r in rows if r.is_context]
    q = [r for r in rows if not r.is_context]
    y = [r.target for r in c] if n_classes is None else [r.y for r in c]
    out = A.attention_scorer(n_classes)(np.array([r.x for r in c]), np.array(y, float), np.array([r.x for r in q]))
    return {r.row_id: o for r, o in zip(q, out, strict=True)}


@pytest.mark.parametrize(("piece", "most"), [(7, 11), (64, 1000), (10_000, 5)])
def test_blocks_give_what_the_whole_context_does(spark, piece, most):
    d = drawn(spark, 300, 40)
    for n in (4, None):
        c = d.where("is_context").withColumn("table", F.lit("t"))
        stored = A.store_context(c.withColumn("y", F.col("target")) if n is None else c, n)
        got = {r.row_id: r.output for r in A.attend(stored, d.where("not is_context").withColumn("table", F.lit("t")), piece, most).collect()}
        want = plain(d, n)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_large_tables_of_a_collection_take_the_stored_way(spark):
    parts = [drawn(spark, 20 + 150 * (t == 2), 30, seed=t).withColumn("dataset_id", F.lit(t).cast("long")) for t in range(4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).withColumnRenamed("row_id", "row_idx")
    for n in (4, None):
        own = rows if n else rows.withColumn("y", F.col("target"))
        one = {(r.dataset_id, r.row_idx): r for r in A.score_collection(own, A.attention_scorer(n)).collect()}
        cut = {(r.dataset_id, r.row_idx): r for r in A.score_collection(own, A.attention_scorer(n), 8, max_context=100).collect()}
        assert one.keys() == cut.keys() and len(one) == 120
        assert all(np.allclose(one[k].output, cut[k].output, atol=1e-12) and one[k].y == cut[k].y for k in one)
    with pytest.raises(ValueError, match="more than 100 context rows in tables"):
        A.score_collection(rows, A.model_scorer(kernel.random_weights(1, 2, 8, 16, 4)), max_context=100)


def test_estimators_of_fifty_thousand_context_rows(spark, tmp_path):
    d = drawn(spark, 50_000, 60).select("row_id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), "y", "target", "is_context")
    train, rest = d.where("is_context"), d.where("not is_context")
    small, large = InContextClassifier(["a", "b"], max_context=60_000).fit(train), InContextClassifier(["a", "b"]).fit(train)
    assert small.stored is None and large.stored is not None
    want = {r.row_id: r for r in small.transform(rest).collect()}
    got = large.transform(rest)
    assert got.columns == small.transform(rest).columns
    rows = {r.row_id: r for r in got.collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[k].proba, want[k].proba, atol=1e-9) for k in want)
    train = train.withColumn("y", F.col("target"))
    a, b = ({r.row_id: r.prediction for r in InContextRegressor(["a", "b"], max_context=m).fit(train).transform(rest).collect()} for m in (60_000, 10_000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    # a stream, by micro-batches
    rest.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rest.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="micro-batches"):
        large.transform(stream)
    R.score_stream(stream, lambda df: large.transform(df).select("row_id", "prediction"), R.to_table(str(tmp_path / "out")), str(tmp_path / "state"))
    told = {r.row_id: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert told == {k: r.prediction for k, r in want.items()}
    with pytest.raises(ValueError, match="more than 100 context"):
        InContextClassifier(["a", "b"], scorer=A.model_scorer(kernel.random_weights(1, 2, 8, 16, 4)), max_context=100).fit(d.where("is_context"))


def test_no_context_and_missing_numbers(spark):
    d = drawn(spark, 30, 5)
    out = A.attend_table(d.where("row_id < 0"), d.where("not is_context")).collect()
    assert len(out) == 5 and all(np.isnan(r.output).all() for r in out)
    holes = d.withColumn("x", F.when(F.col("row_id") == 31, F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))).otherwise(F.col("x")))
    got = {r.row_id: r.output for r in A.attend_table(holes.where("is_context"), holes.where("not is_context"), 8).collect()}
    want = plain(d, 4)
    assert np.isnan(got[31]).all() and all(np.allclose(got[k], want[k]) for k in want if k != 31)


def test_stream_scoring_has_no_largest_context(spark, tmp_path):
    from tabmill.plans import queries as plans

    rng = np.random.default_rng(2)
    n, d = 2 * A.MAX_CONTEXT + 400, str(tmp_path)
    rows = [(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(rng.normal(size=(n, 64)).astype("f4"))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    got = {r.row_id: r.prediction for r in plans.QUERIES["t2_stream_scoring"](spark, d).collect()}
    assert len(got) == n // 2 and got == {r.row_id: r.prediction for r in plans.QUERIES["a7_classifier"](spark, d).collect()}


def test_tables_together_are_what_each_gives_alone():
    """Tables of other sizes and widths, without context or queries, and with a missing number."""
    rng = np.random.default_rng(5)
    score = A.model_scorer(kernel.random_weights(2, 2, 8, 16, 4))
    tables = [(rng.normal(size=(c, w)), rng.normal(size=c), rng.normal(size=(q, w))) for c, q, w in zip(rng.integers(1, 60, 50), rng.integers(1, 40, 50), rng.integers(2, 4, 50), strict=True)]
    tables += [(np.zeros((0, 3)), np.zeros(0), np.ones((2, 3))), (np.ones((2, 3)), np.ones(2), np.zeros((0, 3))), (rng.normal(size=(300, 3)), rng.normal(size=300), rng.normal(size=(9, 3)))]
    tables[3][2][0, 0] = np.nan
    for t, got in zip(tables, score.many(tables), strict=True):
        assert got.shape == (len(t[2]), 4) and np.allclose(got, score(*t), atol=1e-11, equal_nan=True)


def skewed(spark, n_context, n_query, width):
    """drawn(), with a long tail in the first feature and far values in few rows, and few values in the last."""
    d = drawn(spark, n_context, n_query, 3, width)
    far = F.when(F.col("row_id") % 97 == 0, 40.0).when(F.col("row_id") % 89 == 0, -15.0).otherwise(1.0)
    x = [F.get("x", F.lit(k)) for k in range(width)]
    x[-1] = F.floor(x[-1]).cast("double")
    return d.withColumn("x", F.array(F.exp(2 * F.get("x", F.lit(0))) * far, *x[1:]))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sums_by_cells_give_what_all_pairs_do(spark, width):
    d = skewed(spark, 12_000, 900, width)
    for n in (3, None):
        c, q = (d.where(w).withColumn("table", F.lit("t")) for w in ("is_context", "not is_context"))
        stored = A.store_context(c.withColumn("y", F.col("target")) if n is None else c, n)
        levels = spark.createDataFrame([("t", 0), ("t", 1)], "table string, level int")
        assert A.summed(stored, levels).where("w is not null").groupBy("level").count().count() == 2
        got = {r.row_id: r.output for r in A.attend(stored, q, worth=1).collect()}
        want = plain(d, n)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-11, atol=1e-12) for k in want)


def test_missing_numbers_beside_sums_by_cells(spark):
    """A query row's own, and a context row's, which all answers of its table miss; tables of other widths."""
    hole = F.array(F.lit(None).cast("double"), F.lit(1.0))
    one, two = skewed(spark, 3000, 50, 2), drawn(spark, 40, 10, 3, 6)
    one = one.withColumn("x", F.when(F.col("row_id") == 3007, hole).otherwise(F.col("x")))
    bad = one.withColumn("x", F.when(F.col("row_id") == 5, hole).otherwise(F.col("x")))
    d = one.withColumn("table", F.lit(0)).unionByName(two.withColumn("table", F.lit(1))).unionByName(bad.withColumn("table", F.lit(2)))
    got = {(r.table, r.row_id): r.output for r in A.attend(A.store_context(d.where("is_context"), 3), d.where("not is_context"), worth=1).collect()}
    assert len(got) == 110 and all(np.isnan(got[2, k]).all() for k in range(3000, 3050)) and np.isnan(got[0, 3007]).all()
    for t, own in ((0, one.where("row_id <> 3007")), (1, two)):
        assert all(np.allclose(got[t, k], w, rtol=1e-11, atol=1e-12) for k, w in plain(own, 3).items())


def test_what_meets_query_rows_does_not_grow_with_a_narrow_context(spark):
    """Four times the context of one shape: the rows and cells that a level's query rows meet stay about as many."""
    levels, met = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "table int, level int"), []
    for n in (20_000, 80_000):
        stored = A.store_context(drawn(spark, n, 0, 2, 2).withColumn("table", F.lit(0)), 2)
        got = A.summed(stored, levels).cache()
        met.append(got.count())
        rows = got.groupBy("level").agg(F.sum(F.coalesce(F.get("w", F.lit(2 * 153)), F.lit(1.0))).alias("n")).collect()
        assert {r.level: round(r.n) for r in rows} == {0: n, 1: n, 2: n}
    assert met[0] < 2000 and met[1] < 1.2 * met[0]

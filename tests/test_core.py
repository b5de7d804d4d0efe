"""Hand-made cases and routes that must agree."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.functions import kernel
from tabmill.functions.arrays import argmax, clip, pad, softmax
from tabmill.functions.numbers import to_number
from tabmill.operators import attention as A
from tabmill.operators import batches as B
from tabmill.operators import distribution as D
from tabmill.operators import metrics as M
from tabmill.operators import normalize as N
from tabmill.operators import preprocess as P
from tabmill.operators.estimators import InContextClassifier, InContextRegressor
from tabmill.operators.ranking import global_rank
from tabmill.plans import benchmark as E
from tabmill.plans import fixtures as X
from tabmill.sources import collections as C
from tabmill.sources import generate as G
from tabmill.sources import tasks as T
from tabmill.streaming import replay as R


# ---- batches


@pytest.mark.parametrize(("n", "size", "start"), [(7, 3, 2), (10, 5, 0), (10, 4, 9), (1, 3, 0), (6, 2, 3), (5, 8, 4)])
def test_plan_is_the_pointer_loop(spark, n, size, start):
    want, at = [], start
    for k in range(11):
        want += [(k, p) for p in range(at, min(at + size, n))]
        at = 0 if at + size >= n else at + size
    got = B.batch_plan(spark, n, size, 11, start=start).select("batch_no", "dataset_pos").collect()
    assert sorted(map(tuple, got)) == want


def test_plan_limits(spark):
    assert B.batch_plan(spark, 0, 3, 5).count() == 0
    with pytest.raises(ValueError):
        B.batch_plan(spark, 5, 3, 5, start=5)
    with pytest.raises(ValueError):
        B.accumulation_groups(spark.createDataFrame([(0, 1.0)], "batch_no long, loss double"), 3, 8)
    first = B.batch_plan(spark, 10, 4, 5, epochs=3).where("epoch = 2 and step = 0").agg(F.min("dataset_pos")).first()[0]
    assert B.start_of_epoch(2, 5, 4, 10) == first


def test_bad_batches(spark):
    nan = float("nan")
    rows = [(0, [1.0], 1.0, True), (0, [1.0], None, False), (1, [nan], 1.0, False), (2, [1.0], nan, True), (3, [None], 1.0, True), (4, [2.0], 1.0, True)]
    d = spark.createDataFrame(rows, "batch_no long, x array<double>, y double, is_context boolean")
    assert sorted(r.batch_no for r in B.bad_batches(d).collect()) == [1, 2, 3]
    assert sorted({r.batch_no for r in B.drop_bad_batches(d).collect()}) == [0, 4]


# ---- functions


def test_numbers(spark):
    good = {" 1 ": 1.0, "1e3": 1000.0, "inf": math.inf, ".5": 0.5, "5.": 5.0, "+3": 3.0, "-Infinity": -math.inf}
    bad = ["", "NA", "0x10", "1_000", "1,000", "true", "1e", "1d", "1f", "nan", None, "--1"]
    d = spark.createDataFrame([(x,) for x in [*good, *bad]], "v string").select("v", to_number(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in d} == good | dict.fromkeys(bad)


def test_arrays(spark):
    d = spark.createDataFrame([([1000.0, 1001.0, 1001.0],), ([0.0],), (None,)], "x array<double>")
    got = d.select(softmax(F.col("x")).alias("p"), argmax(F.col("x")).alias("k"), pad(F.col("x"), 2).alias("w")).collect()
    assert math.isclose(sum(got[0].p), 1) and got[0].k == 1 and got[0].p[1] == got[0].p[2] and got[1].w == [0.0, 0.0] and got[2].k is None
    c = spark.createDataFrame([(float("nan"),), (None,), (1e9,), (-1e9,), (3.0,)], "v double").select(clip(F.col("v")).alias("c")).collect()
    assert [r.c for r in c] == [None, None, 100.0, -100.0, 3.0]


def test_erf():
    x = np.linspace(-6, 6, 1001)
    assert np.abs(kernel.erf(x) - np.vectorize(math.erf)(x)).max() < 1e-12


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_global_rank(spark, parts):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500).tolist()
    d = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "k long, v long")
    got = global_rank(d, ["v", "k"], "r", parts).orderBy("r").collect()
    assert [r.r for r in got] == list(range(500)) and [(r.v, r.k) for r in got] == sorted((x, k) for k, x in enumerate(v))


def test_global_rank_of_many_rows(spark):
    """Every rank once and in order, with a payload column that the offsets don't read, at sizes where range bounds are sampled."""
    n = 1_000_000
    d = spark.range(n, numPartitions=16).select(F.xxhash64("id").alias("k"), F.concat(F.lit("p"), F.col("id")).alias("payload"))
    got = global_rank(d, ["k"], "r", 8)
    facts = got.agg(F.count_distinct("r").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count_distinct("payload").alias("p")).first()
    assert (facts.n, facts.lo, facts.hi, facts.p) == (n, 0, n - 1, n)
    from pyspark.sql import Window

    steps = got.withColumn("cell", F.floor(F.col("r") / 5000)).withColumn("next", F.lead("k").over(Window.partitionBy("cell").orderBy("r")))
    assert steps.where("next <= k").count() == 0
    ends = got.groupBy(F.floor(F.col("r") / 5000).alias("cell")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("cell").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:], strict=False))


def test_positions_of_many_tables(spark):
    n = 100_000
    rows = spark.range(2 * n, numPartitions=16).select((F.floor(F.col("id") / 2) * 7).alias("dataset_id"), (F.col("id") % 2).cast("int").alias("row_idx"), F.array(F.col("id").cast("double")).alias("x"), F.lit(0.0).alias("y"))
    got = C.describe(rows)
    assert got.where(F.col("dataset_pos") * 7 != F.col("dataset_id")).count() == 0
    assert got.agg(F.count_distinct("dataset_pos"), F.max("dataset_pos")).first()[:] == (n, n - 1)


# ---- scaling and buckets


def rows_of(spark, tables, split):
    rows = [(t, k, [float(v) for v in x], float(y), k < split) for t, (xs, ys) in enumerate(tables) for k, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "dataset_id long, row_idx int, x array<double>, y double, is_context boolean")


def test_constant_context_feature_and_single_row(spark):
    d = rows_of(spark, [([[5], [5], [6], [4]], [1, 1, 2, 3])], 2)
    assert [r.x[0] for r in N.normalize_features(d, 1).orderBy("row_idx").collect()] == [0.0, 0.0, 100.0, -100.0]
    one = N.normalize_features(rows_of(spark, [([[5], [6]], [1, 2])], 1), 1).orderBy("row_idx").collect()
    assert [r.x for r in one] == [[None], [None]]  # a single row has no deviation
    assert [r.y_known for r in N.fill_targets(d).orderBy("row_idx").collect()] == [1.0, 1.0, 1.0, 1.0]


@pytest.mark.parametrize(("n", "buckets"), [(10, 10), (23, 4), (40, 4), (12, 1)])
def test_bucket_edges(spark, n, buckets):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n)
    d = spark.createDataFrame([(0, 0, k, float(v)) for k, v in enumerate(y)], "dataset_id long, dataset_pos long, row_idx int, y double")
    z = (y - y.mean()) / (y.std(ddof=1) + 1e-8)
    z = np.sort(z[: n - n % buckets])
    m = len(z) // buckets
    want = [z[0], *((z[m * j - 1] + z[m * j]) / 2 for j in range(1, buckets)), z[-1]]
    got = N.bucket_edges(d, buckets).orderBy("bucket").collect()
    assert np.allclose([r.lo for r in got], want[:-1]) and np.allclose([r.hi for r in got], want[1:])
    inside = N.bucketize(d.select(F.explode(F.array(*(F.lit(float(v)) for v in [-9, *want, 9]))).alias("z")).limit(len(want) + 2), spark.createDataFrame(got), "z").select("bucket").collect()
    assert [r.bucket for r in inside] == [0, *range(buckets), buckets - 1, buckets - 1]
    with pytest.raises(ValueError):
        N.bucket_edges(d.limit(3), 5)


def test_tails_are_densities(spark):
    edges = [-2.0, -1.0, 0.5, 3.0]
    x = np.linspace(-40, 40, 20_001)
    d = spark.createDataFrame([(float(v),) for v in x], "y double").withColumn("logits", F.array(F.lit(0.3), F.lit(-1.0), F.lit(0.7)))
    d = N.bucketize(d, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bucket int, lo double, hi double"), "y")
    p = np.exp([-r.l for r in d.select("y", D.bucket_loss(F.col("logits"), F.col("bucket"), F.col("y"), edges).alias("l")).orderBy("y").collect()])
    assert abs((p[1:] + p[:-1]).sum() / 2 * (x[1] - x[0]) - 1) < 1e-3
    mean = spark.range(1).select(D.distribution_mean(F.array(F.lit(0.3), F.lit(-1.0), F.lit(0.7)), edges).alias("m")).first().m
    assert abs((p * x).sum() * (x[1] - x[0]) - mean) < 5e-3


# ---- preprocessing


def test_preprocessor(spark):
    train = spark.createDataFrame([(1.0, "b", None, "k", True), (float("nan"), "a", "1", "k", False), (3.0, "a", "2", "k", None), (None, None, " 3 ", "k", True)], "n double, c string, s string, k string, t boolean")
    m = P.TablePreprocessor(["n", "c", "s", "k", "t"]).fit(train)
    assert m.dropped == ["k"] and m.feature_names == ["n", "s", "t", "n_missing", "s_missing", "t_missing", "c", "c_missing"]
    assert m.means == {"n": 2.0, "s": 2.0, "t": pytest.approx(2 / 3)} and m.codes == {"c": {"a": 0.0, "b": 1.0}} and m.fill == {"c": 0.0}
    got = m.transform(spark.createDataFrame([(None, "new", "x", "z", None), (9.0, "b", "4", "k", False)], train.schema)).collect()
    assert [r.x for r in got] == [[2.0, 2.0, pytest.approx(2 / 3), 1.0, 1.0, 1.0, 0.0, 1.0], [9.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]]
    assert not [v for r in m.transform(train).collect() for v in r.x if v is None]
    with pytest.raises(ValueError):
        P.TablePreprocessor(["c"], max_categories=1).fit(train)
    tie = P.most_frequent(P.ordinal_codes(spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string"), ["c"])).first()
    assert tie.code == 0.0


def test_unseen_label_is_an_error(spark):
    codes = P.label_codes(spark.createDataFrame([("b",), ("a",), (None,)], "l string"), "l")
    assert [(r.value, r.y) for r in codes.orderBy("y").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="label not seen at fit: c"):
        P.encode_labels(spark.createDataFrame([("c",)], "l string"), "l", codes).collect()


# ---- scoring


def test_scoring_routes_agree(spark, sf):
    weights = kernel.random_weights(2, 2, 16, 32, 10)
    e = X.embedding_task(spark, sf).select("row_id", F.slice("x", 1, 4).alias("x"), "y", "is_context").where("row_id < 120")
    x, y = A.collect_context(e.where("is_context"))
    for score in (A.model_scorer(weights), A.attention_scorer(10)):
        wide = {r.row_id: r.output for r in A.score_table(e.where("not is_context").repartition(3), x, y, score).collect()}
        long = e.select(F.lit(1).alias("dataset_id"), F.col("row_id").alias("row_idx"), "x", "y", "is_context").repartition(2)
        ordered = A.score_collection(long, score)
        assert all(np.allclose(r.output, wide[r.row_idx], atol=1e-6) for r in ordered.collect()) and ordered.count() == len(wide)
    f = kernel.Forward(weights, x, y)
    q = np.random.default_rng(0).normal(size=(9, 4))
    assert np.allclose(f.score(q), np.concatenate([f.score(q[k : k + 2]) for k in range(0, 9, 2)]), atol=1e-12)
    with pytest.raises(ValueError):
        A.collect_context(e.where("is_context"), 10)


def test_slices_of_a_large_table_agree(spark):
    """A table's query rows are answered alike in one group and in many."""
    rng = np.random.default_rng(3)
    rows = [(t, k, rng.normal(size=3).tolist(), float(rng.integers(0, 3)), k < 40 * t) for t in (1, 2) for k in range(400)]
    d = spark.createDataFrame(rows, "dataset_id long, row_idx int, x array<double>, y double, is_context boolean")
    for score in (A.attention_scorer(3), A.model_scorer(kernel.random_weights(1, 2, 8, 16, 3))):
        one = {(r.dataset_id, r.row_idx): r.output for r in A.score_collection(d, score).collect()}
        cut = A.score_collection(d, score, 50).collect()
        assert len(cut) == len(one) == 680 and all(np.allclose(r.output, one[r.dataset_id, r.row_idx], atol=1e-9) for r in cut)


def test_bucket_regressor_is_the_estimator(spark, sf):
    """The grouped query gives a table what the one-table estimator's parts give it."""
    from tabmill.plans import queries as plans

    got = {r.row_idx: r.prediction for r in plans.QUERIES["a8_bucket_regressor"](spark, sf).where("dataset_id = 3").collect()}
    edges = plans.event_edges(spark, sf)[1].orderBy("bucket").collect()
    at = [r.lo for r in edges] + [edges[-1].hi]
    own = X.event_tables(spark, sf)[0].where("dataset_id = 3").orderBy("row_idx").collect()
    x, y, on = np.array([r.x for r in own]), np.array([r.value for r in own]), np.array([r.is_context for r in own])
    mean, std = y[on].mean(), y[on].std(ddof=1) + 1e-8
    logits = kernel.Forward(kernel.random_weights(1, 2, 8, 16, 10), x[on], (y[on] - mean) / std).score(x[~on])
    want = kernel.softmax(logits) @ np.array(D.bucket_means(at)) * std + mean
    assert np.allclose([got[r.row_idx] for r in own if not r.is_context], want, atol=1e-4)


def test_suites(spark):
    tasks = spark.createDataFrame([(59, "iris"), (363612, "a"), (1, "other")], "task_id int, dataset_name string")
    suites = T.built_in_suites(spark)
    assert {r.dataset_name for r in T.resolve(tasks, suites, "toy_classification").collect()} == {"iris"}
    assert {r.dataset_name for r in T.resolve(tasks, suites, [1, 59]).collect()} == {"iris", "other"} and len(T.ARENA) == len(set(T.ARENA)) == 51


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from tabmill.sources.storage import scratch

    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError, match="checkpoint"):
        scratch(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")), "t")


def test_saved_weights(spark, tmp_path):
    w = kernel.random_weights(1, 2, 8, 16, 3)
    T.save_weights(spark, w, str(tmp_path / "w"))
    back = T.load_weights(spark, str(tmp_path / "w"))
    assert w.keys() == back.keys() and all(np.array_equal(w[k], back[k]) for k in w)


def test_estimators(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(v), "ab"[k % 2], int(v > 0), float(3 * v + 100)) for k, v in enumerate(rng.normal(size=80))]
    d = spark.createDataFrame(rows, "row_id long, v double, c string, y int, t double")
    fit, rest = d.where("row_id < 60"), d.where("row_id >= 60")
    got = InContextClassifier(["v", "c"]).fit(fit).transform(rest).collect()
    assert np.mean([r.prediction == r.y for r in got]) > 0.8 and all(math.isclose(sum(r.proba), 1) for r in got)
    reg = InContextRegressor(["v"]).fit(fit.drop("y").withColumnRenamed("t", "y")).transform(rest.drop("y").withColumnRenamed("t", "y")).collect()
    assert np.corrcoef([r.prediction for r in reg], [r.y for r in reg])[0, 1] > 0.8
    edges = [-2.0, 0.0, 2.0]
    full = InContextRegressor(["v"], A.model_scorer(kernel.random_weights(1, 1, 4, 8, 2)), edges).fit(fit.drop("y").withColumnRenamed("t", "y"))
    assert all(math.isfinite(r.prediction) for r in full.transform(rest.drop("y").withColumnRenamed("t", "y")).collect())
    logits = InContextClassifier(["v"], A.model_scorer(kernel.random_weights(1, 1, 4, 8, 5))).fit(fit).transform(rest).collect()
    assert all(len(r.proba) == 2 and math.isclose(sum(r.proba), 1) for r in logits)


# ---- metrics


def test_auc(spark):
    d = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False), ("a", 0.9, True), ("a", 0.1, False), ("one", 0.3, True), ("one", 0.4, True)], "k string, score double, positive boolean")
    got = {r.k: r.roc_auc for r in M.roc_auc(d, ["k"]).collect()}
    assert got == {"a": 0.875, "one": None}
    back = {r.k: r.roc_auc for r in M.roc_auc(d.withColumn("score", -F.col("score")), ["k"]).collect()}
    assert back["a"] == 1 - 0.875


def test_r2_of_constant_targets(spark):
    d = spark.createDataFrame([("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("off", 2.0, 2.5), ("off", 2.0, 2.0), ("real", 1.0, 1.0), ("real", 3.0, 2.0)], "dataset string, y_true double, y_pred double")
    assert {r.dataset: r.r2 for r in M.r2(d, ["dataset"]).collect()} == {"exact": 1.0, "off": 0.0, "real": 0.5}


def test_benchmark_of_both_kinds(spark, sf):
    docs = X.document_task(spark, sf)
    task = E.Task("docs", "classification", docs.withColumn("y", F.col("quality")), ["n_words", "uniq_ratio", "lang"])
    reg = E.Task("chars", "regression", docs.withColumn("y", F.col("n_chars")).drop("n_chars"), ["n_words", "lang"])
    got = {(r.dataset, r.metric): r.value for r in E.run_benchmark([task, reg]).collect()}
    assert got["docs", "roc_auc"] == got["average", "roc_auc"] and 0 <= got["docs", "accuracy"] <= 1 and got["chars", "r2"] <= 1


# ---- collections, generators, streams


def test_write_read_pad_trim(spark, tmp_path):
    rows = spark.createDataFrame([(5, 0, [1.0, 2.0], 0.0), (5, 1, [3.0, 4.0], 1.0), (9, 0, [5.0], 1.0)], C.ROWS)
    sizes = C.describe(rows)
    assert [(r.dataset_id, r.dataset_pos, r.n_rows, r.n_features, r.split_index) for r in sizes.orderBy("dataset_id").collect()] == [(5, 0, 2, 2, 1), (9, 1, 1, 1, 0)]
    C.write_collection(rows, sizes, str(tmp_path / "c"), "regression", 7)
    got, back, facts = C.read_collection(spark, str(tmp_path / "c"))
    assert sorted(got.collect()) == sorted(rows.collect()) and back.count() == 2 and facts == {"problem_type": "regression", "original_batch_size": "1"}
    padded = C.pad_collection(rows, 4, 3)
    assert padded.count() == 8 and all(len(r.x) == 3 for r in padded.collect())
    assert sorted(C.trim_collection(padded, sizes).select("dataset_id", "row_idx", "x", "y").collect()) == sorted(rows.collect())
    assert C.probe(back.drop("n_rows")).first().has_n_rows is False
    with pytest.raises(ValueError):
        C.split_field(rows)


def test_generators_don_t_depend_on_partitions(spark):
    tables = lambda n: G.draw_sizes(spark.range(12).repartition(n).withColumnRenamed("id", "dataset_id"), 3, (20, 30), (2, 4), 5)
    sizes = tables(1).collect()
    assert all(20 <= r.n_rows <= 30 and 2 <= r.n_features <= 4 and 5 <= r.split_index < r.n_rows for r in sizes)
    for name in G.PRIORS:
        one = sorted(G.generate_collection(tables(1), name, 3)[0].collect())
        assert one == sorted(G.generate_collection(tables(8), name, 3)[0].collect()) and len(one) == sum(r.n_rows for r in sizes)
        assert all(0 <= v <= 1 for r in one for v in r.x)
    full = G.as_classification(G.mlp(tables(2), 3), tables(2), 3, 4)
    assert full.count() == sum(r.n_rows for r in sizes) and all(r.y in (0, 1, 2, 3) for r in full.collect())
    with pytest.raises(ValueError):
        G.generate_collection(tables(1), "none", 3)


def test_draws_have_their_shares(spark):
    t = spark.range(4000).withColumnRenamed("id", "dataset_id")
    n = G.class_counts(t, 1, 5).groupBy("n_classes").count().collect()
    share = {r.n_classes: r["count"] / 4000 for r in n}
    assert abs(share[2] - 0.625) < 0.04 and all(abs(share[k] - 0.125) < 0.03 for k in (3, 4, 5))
    mlp = G.is_mlp_in_bag(t, 1).agg(F.avg(F.col("is_mlp").cast("double"))).first()[0]
    assert abs(mlp - math.e / (1 + math.e)) < 0.03
    gp = G.gp_table(G.GP_A, np.random.default_rng(0).random((400, 1)), np.random.default_rng(1))
    assert 0.05 < gp.std() < 6


def test_user_functions_and_hooks(spark, tmp_path):
    seen = []
    losses = spark.createDataFrame([("r", k, float(k)) for k in range(8)], "run string, batch_no long, loss double")
    losses.repartition(3).write.parquet(str(tmp_path / "l"))
    R.run_once(R.running_losses(R.replay(spark, str(tmp_path / "l"), "run string, batch_no long, loss double"), 4), R.at_epoch_end(lambda df: seen.append(sorted(map(tuple, df.collect())))), str(tmp_path / "s"), "update")
    assert {x for s in seen for x in s if x[2] == 4} == {("r", 0, 4, 1.5), ("r", 1, 4, 5.5)}
    T.log_metrics(losses.select("run", F.col("batch_no").alias("epoch"), F.lit("loss").alias("name"), F.col("loss").alias("value")), str(tmp_path / "m"))
    assert T.metrics_view(spark, str(tmp_path / "m"), ["loss"]).count() == 8


def test_one_table_has_no_largest_context(spark, tmp_path):
    from tabmill.plans import queries as plans

    rng = np.random.default_rng(0)
    n = 24_000
    x = rng.normal(size=(n, 16)).astype("f4")
    x[:50] *= 30  # so that blocks' largest products differ by much
    d = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 3, n), strict=True))], "vec_id long, embedding array<float>, label int")
    d.write.parquet(str(tmp_path / "embeddings.parquet"))
    e = X.embedding_task(spark, str(tmp_path)).orderBy("row_id").collect()
    on = np.array([r.is_context for r in e])
    z, y = np.array([r.x for r in e], float), np.array([r.y for r in e])
    assert on.sum() > A.MAX_CONTEXT
    some = np.nonzero(~on)[0][::97]
    want = A.attention_scorer(int(y[on].max()) + 1)(z[on], y[on], z[some])
    got = {}
    for r in plans.QUERIES["a1_one_table_attention"](spark, str(tmp_path)).collect():
        got.setdefault(r.row_id, {})[r["class"]] = r.p
    assert len(got) == (~on).sum()
    for k, w in zip(some, want, strict=True):
        assert np.allclose([got[e[k].row_id][c] for c in range(len(w))], w, atol=2e-6)

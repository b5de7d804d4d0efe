from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.operators.batches import batch_plan
from tabmill.plans.queries import ORACLES, QUERIES
from tabmill.sources import collections as C
from tabmill.sources import datasource as D
from tabmill.sources import tasks as T
from tabmill.sources.log import CommitLog
from tabmill.streaming import replay as R
from tests.oracle import compare
from tests.test_collections import append


@pytest.mark.parametrize(("n", "size", "steps", "epochs", "start"), [(10, 3, 4, 2, 0), (7, 4, 3, 1, 5), (3, 8, 2, 3, 1)])
def test_the_plan_source_is_the_plan(spark, n, size, steps, epochs, start):
    D.register(spark)
    numbers = {"n_tables": n, "batch_size": size, "num_steps": steps, "epochs": epochs, "start": start, "slices": 3}
    got = spark.read.format("tabmill_batches").options(**{k: str(v) for k, v in numbers.items()}).load()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch_plan(spark, n, size, steps, epochs, start).select("batch_no", "epoch", "step", "dataset_pos").collect()))


def test_replay_keeps_order_and_resumes_at_any_batch(spark, tmp_path):
    path = str(tmp_path / "c")
    append(spark, path, range(7), "overwrite", block_tables=2)
    append(spark, path, range(20, 24), block_tables=2)
    c = C.open_collection(spark, path)
    want = {}
    for r in c.scan(3, 6, start=4).select("batch_no", "dataset_id").distinct().collect():
        want.setdefault(r.batch_no, set()).add(r.dataset_id)
    seen = []

    def sink(df, no):
        rows = df.select("batch_no", "dataset_id").distinct().collect()
        if stop and len(seen) == stop:
            raise RuntimeError("stopped")
        seen.append(({r.batch_no for r in rows}, {r.dataset_id for r in rows}))

    for stop in (1, 4):
        with pytest.raises(Exception, match="stopped"):
            R.replay_batches(spark, path, sink, str(tmp_path / "state"), 3, 6, start=4)
        assert len(seen) == stop
    stop = None
    assert R.replay_batches(spark, path, sink, str(tmp_path / "state"), 3, 6, start=4) == 2
    assert seen == [({k}, want[k]) for k in range(6)]
    assert R.replay_batches(spark, path, sink, str(tmp_path / "state"), 3, 6, start=4) == 0


def test_a_trigger_takes_many_micro_batches_and_reads_its_blocks(spark, tmp_path):
    path = str(tmp_path / "c")
    append(spark, path, range(40), "overwrite", block_tables=2)
    append(spark, path, range(40, 45), block_tables=2)
    seen, files = [], []

    def sink(df, no):
        seen.append(sorted({(r.micro_batch, r.batch_no, r.dataset_id) for r in df.collect()}))
        files.append({f.split("commit=")[1].split("/part")[0] for f in df.inputFiles() if "/rows/" in f})

    for steps, triggers in ((6, 1), (15, 2)):  # stopped after six batches, then gone on to the end
        assert R.replay_batches(spark, path, sink, str(tmp_path / "state"), 3, steps, each=2, at_once=3) == triggers
    assert seen == [[(d // 6, d // 3, d) for d in range(a, min(a + 18, 45))] for a in (0, 18, 36)]
    first, last = (c["folder"] for c in C.open_collection(spark, path).commits)
    assert files[0] == {f"{first}/block={b}" for b in range(0, 18, 2)} and files[2] == {f"{first}/block={b}" for b in (36, 38)} | {f"{last}/block={b}" for b in (40, 42, 44)}


def test_a_function_as_a_source(spark, tmp_path):
    def batch(size, longest, width):
        return {"x": np.arange(size * longest * width).reshape(size, longest, width), "y": np.arange(size * longest).reshape(size, longest), "train_test_split_index": 1}

    spark.dataSource.register(D.function_source("grid", batch))
    options = {"num_steps": "5", "batch_size": "2", "num_datapoints_max": "3", "num_features": "2", "steps_per_trigger": "2"}
    want = sorted(map(tuple, C.from_function(spark, batch, 5, 2, 3, 2).select("step", "dataset_id", "row_idx", "x", "y", "split_index").collect()))
    assert sorted(map(tuple, spark.read.format("grid").options(**options).load().collect())) == want
    q = spark.readStream.format("grid").options(**options).load().writeStream.foreachBatch(R.to_table(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("step", "dataset_id", "row_idx", "x", "y", "split_index").collect())) == want
    assert {(r.micro_batch, r.step) for r in got.select("micro_batch", "step").distinct().collect()} >= {(0, 0), (0, 1), (1, 2), (1, 3)}


def losses(spark, rows):
    return spark.createDataFrame(rows, "run string, epoch long, name string, value double")


def test_metrics_are_logged_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    assert T.log_metrics(losses(spark, [("a", 1, "loss", 0.5), ("a", 1, "acc", 0.1), ("b", 1, "loss", 9.0)]), path, "train", 0)
    # the same micro-batch again, with other values: left as it was
    assert not T.log_metrics(losses(spark, [("a", 1, "loss", 7.0)]), path, "train", 0)
    # an epoch that is run again takes the earlier one's place
    assert T.log_metrics(losses(spark, [("a", 1, "loss", 0.25), ("a", 2, "loss", 0.2)]), path)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before its manifest")))
        with pytest.raises(RuntimeError):
            T.log_metrics(losses(spark, [("a", 1, "loss", 100.0)]), path, "train", 1)
    with pytest.raises(ValueError, match="more than one value"):
        T.log_metrics(losses(spark, [("a", 3, "loss", 1.0), ("a", 3, "loss", 2.0)]), path)
    got = sorted(map(tuple, T.metrics_view(spark, path, ["loss", "acc"]).collect()))
    assert got == [("a", 1, 0.25, 0.1), ("a", 2, 0.2, None), ("b", 1, 9.0, None)]


def test_two_writers_of_one_micro_batch_leave_one(spark, tmp_path, monkeypatch):
    path, put, others = str(tmp_path / "m"), CommitLog.put, [1]

    def late(self, no, entry):
        if others and others.pop():
            assert T.log_metrics(losses(spark, [("a", 1, "loss", 1.0)]), path, "s", 4)
        return put(self, no, entry)

    monkeypatch.setattr(CommitLog, "put", late)
    assert not T.log_metrics(losses(spark, [("a", 1, "loss", 2.0)]), path, "s", 4)
    assert [r.value for r in T.read_metrics(spark, path).collect()] == [1.0]


def test_a_replayed_micro_batch_leaves_one_row(spark, tmp_path):
    source, path = str(tmp_path / "l"), str(tmp_path / "m")
    spark.range(12).select(F.lit("r").alias("run"), F.col("id").alias("batch_no"), F.col("id").cast("double").alias("loss")).repartition(3, "batch_no").write.parquet(source)
    stream = R.running_losses(R.replay(spark, source, "run string, batch_no long, loss double"), 4)
    for state in ("s1", "s2"):  # the second run has no checkpoint: all its micro-batches are replays
        R.run_once(stream, R.to_metrics(path, "losses"), str(tmp_path / state), "update")
    assert T.read_metrics(spark, path).count() == 6
    assert sorted((r.epoch, r.n_batches, r.mean_loss) for r in T.metrics_view(spark, path, ["n_batches", "mean_loss"]).collect()) == [(0, 4.0, 1.5), (1, 4.0, 5.5), (2, 4.0, 9.5)]


@pytest.mark.parametrize("name", ["t1_ordered_replay", "t3_running_metrics", "s14_run_metrics", "e10_evaluation_log"])
def test_queries(spark, sf, name):
    name = name if name in QUERIES else next(q for q in QUERIES if q.startswith(name.split("_")[0] + "_"))
    assert compare(spark, name, QUERIES[name], ORACLES[name], sf) == ""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabmill.operators.batches import batch_plan, plan_ranges
from tabmill.sources import collections as C
from tabmill.sources.log import CommitLog


def tables(spark, ids, n_rows=5):
    """Rows of tables with these ids; y tells them apart."""
    rows = [(i, r, [float(i), float(r)], float(100 * i + r)) for i in ids for r in range(n_rows)]
    return spark.createDataFrame(rows, C.ROWS)


def append(spark, path, ids, mode="append", **more):
    rows = tables(spark, ids)
    C.write_collection(rows, C.describe(rows), path, "regression", None, 2, mode, **more)


def leaf_metrics(df):
    """Files and rows that the scans of a collected plan read."""
    files = rows = 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
            continue
        children = p.children()
        if p.nodeName().endswith("QueryStage"):
            stack.append(p.plan())
        if children.isEmpty() and p.metrics().contains("numFiles"):
            files += p.metrics().apply("numFiles").value()
            rows += p.metrics().apply("numOutputRows").value()
        stack += [children.apply(k) for k in range(children.size())]
    return files, rows


def test_positions_go_on_from_append_to_append(spark, tmp_path):
    path = str(tmp_path / "c")
    for k, ids in enumerate(([3, 1, 2, 9], [8, 5], [4, 7])):
        append(spark, path, ids, "append" if k else "overwrite")
    c = C.open_collection(spark, path)
    places = {r.dataset_pos: r.dataset_id for r in c.datasets().collect()}
    assert c.n_tables == 8 and places == dict(enumerate([1, 2, 3, 9, 5, 8, 4, 7]))
    got = {(r.batch_no, r.dataset_id) for r in c.scan(3, 3).select("batch_no", "dataset_id").distinct().collect()}
    assert got == {(k // 3, i) for k, i in enumerate([1, 2, 3, 9, 5, 8, 4, 7])}
    assert c.rows().count() == 40
    C.compact_collection(spark, path)
    assert len(C.open_collection(spark, path).commits) == 1
    again = C.open_collection(spark, path)
    assert {r.dataset_pos: r.dataset_id for r in again.datasets().collect()} == places and sorted(again.rows().collect()) == sorted(c.rows().collect())
    assert len(C.remove_unread(spark, path)) == 3 and again.rows().count() == 40
    append(spark, path, [11, 12], "overwrite")
    assert [r.dataset_id for r in C.open_collection(spark, path).datasets().orderBy("dataset_pos").collect()] == [11, 12]


def test_an_id_may_come_again_in_a_later_commit(spark, tmp_path):
    path = str(tmp_path / "c")
    append(spark, path, [1, 2], "overwrite")
    append(spark, path, [2, 1, 3])
    got = C.open_collection(spark, path).scan(1, 5).groupBy("batch_no").agg(F.count("*").alias("n"), F.max("dataset_id").alias("i")).orderBy("batch_no").collect()
    assert [(r.n, r.i) for r in got] == [(5, 1), (5, 2), (5, 1), (5, 2), (5, 3)]


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    append(spark, path, [1, 2], "overwrite")
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before its manifest")))
        with pytest.raises(RuntimeError):
            append(spark, path, [3, 4])
    assert C.open_collection(spark, path).n_tables == 2 and C.open_collection(spark, path).rows().count() == 10
    append(spark, path, [5])
    c = C.open_collection(spark, path)
    assert [r.dataset_id for r in c.datasets().orderBy("dataset_pos").collect()] == [1, 2, 5] and c.rows().count() == 15
    assert len(C.remove_unread(spark, path)) == 1 and C.open_collection(spark, path).rows().count() == 15


def test_two_writers_get_positions_of_their_own(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    append(spark, path, [1, 2], "overwrite")
    put, others = CommitLog.put, [[7, 8, 9]]

    def late(self, no, entry):
        if others:  # another append commits while this one writes
            append(spark, path, others.pop())
        return put(self, no, entry)

    monkeypatch.setattr(CommitLog, "put", late)
    append(spark, path, [4])
    c = C.open_collection(spark, path)
    assert {r.dataset_pos: r.dataset_id for r in c.datasets().collect()} == dict(enumerate([1, 2, 7, 8, 9, 4]))
    assert c.rows().count() == 30 and C.remove_unread(spark, path) == []


def test_a_batch_range_reads_its_blocks_only(spark, tmp_path):
    path = str(tmp_path / "c")
    append(spark, path, range(40), "overwrite", block_tables=4)
    append(spark, path, range(100, 160), block_tables=8)
    c = C.open_collection(spark, path)
    rows = c.rows([(50, 53)])
    rows.collect()
    files, read = leaf_metrics(rows)
    assert rows.count() == 15 and read <= 8 * 5 and files == 1
    scan = c.scan(2, 2, start=98).select("batch_no", "dataset_id", "x")
    assert {(r.batch_no, r.dataset_id) for r in scan.collect()} == {(0, 158), (0, 159), (1, 0), (1, 1)}
    # of 500 rows: the last block of 8 tables (from position 96), the first of 4, and what the tables' own two files hold
    assert leaf_metrics(scan)[1] <= (4 + 4) * 5 + 100
    assert c.rows([]).count() == 0


def test_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = tables(spark, [1, 2])
    sizes = C.describe(rows)
    with pytest.raises(ValueError, match="count the tables"):
        C.write_collection(rows, sizes.withColumn("dataset_pos", F.lit(0).cast("long")), path, "regression")
    with pytest.raises(Exception, match="not in datasets"):
        C.write_collection(rows, sizes.where("dataset_id = 1"), path, "regression")
    with pytest.raises(FileNotFoundError):
        C.open_collection(spark, path)
    append(spark, path, [1], "overwrite")
    with pytest.raises(ValueError, match="problem type"):
        C.write_collection(rows, sizes, path, "classification", 2, mode="append")
    empty = tables(spark, [])
    C.write_collection(empty, C.describe(empty), path, "regression", mode="append")
    assert C.open_collection(spark, path).n_tables == 1


@pytest.mark.parametrize(("n", "size", "steps", "epochs", "start"), [(10, 3, 2, 1, 0), (10, 3, 2, 1, 8), (10, 3, 5, 1, 4), (7, 3, 1, 1, 2), (5, 9, 4, 2, 3), (4, 2, 0, 1, 0), (1, 1, 3, 1, 0)])
def test_plan_ranges_are_what_the_plan_reads(spark, n, size, steps, epochs, start):
    want = {r.dataset_pos for r in batch_plan(spark, n, size, steps, epochs, start).collect()}
    assert {k for lo, hi in plan_ranges(n, size, steps, epochs, start) for k in range(lo, hi)} == want

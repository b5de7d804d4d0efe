from __future__ import annotations

import numpy as np

from tabmill.llm import ann
from tabmill.llm.queries import op8_nearest_vectors
from pyspark.sql import functions as F


def plain(ids, x, k=5):
    out = {}
    for a, v in zip(ids, x, strict=True):
        if a % 50 == 0:
            s = [(-float(np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w)))), b) for b, w in zip(ids, x, strict=True) if b != a]
            s.sort(key=lambda t: (round(t[0], 12), t[1]))
            out[a] = [(b, -t) for t, b in s[:k]]
    return out


def check(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == sorted(k for k in want if want[k])
    for q, found in got.items():
        assert [v for v, _ in found] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], atol=1e-12)


def test_query_is_exact(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    check(op8_nearest_vectors(spark, sf).collect(), plain(e.vec_id.tolist(), np.array(e.embedding.tolist(), float)))


def test_clusters_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 4))[rng.integers(0, 6, 500)] + rng.normal(size=(500, 4)) * 0.02
    x[100:260] = x[100]  # many copies of one vector
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check(ann.search(d, F.col("id") % 50 == 0, window=32).collect(), plain(range(500), x))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, nan]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1e200, 1e200]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (8, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 id", "2 u", "3 key")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(d.select("vec_id", "embedding"), F.col("id") % 50 == 0).collect()]
    # the two rows of id 50 are each other's candidates, and a query each
    assert sorted(got) == [(0, 1, 50), (0, 2, 50), (0, 3, 7), (50, 1, 0), (50, 1, 0), (50, 2, 50), (50, 2, 50), (50, 3, 7), (50, 3, 7)]
    assert ann.search(d.limit(0), F.col("id") % 50 == 0).count() == 0


def test_hilbert_neighbours():
    grid = np.array([(i, j) for i in range(16) for j in range(16)])
    path = grid[np.argsort(ann.hilbert(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_thousands_of_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7000, 64))
    x[1000:3000] = x[1000] + rng.normal(size=(2000, 64)) * 3e-4  # near copies
    x[3000:5000] = x[3000]  # exact ones
    x[5000:6000] = x[5000] * 2.0 ** rng.integers(-3, 4, 1000)[:, None]  # copies but for their length
    x[6000:7000] = x[6000] + rng.normal(size=(1000, 64)) * 1e-8
    ids = rng.permutation(7000)
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    want = {}
    for a, v in zip(ids, x, strict=True):
        if a % 50 == 0:
            s = np.cumsum(x * v, axis=1)[:, -1] / (norm[ids == a] * norm)
            s[ids == a] = -2
            want[a] = [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:5]]
    check(ann.search(d, F.col("id") % 50 == 0).collect(), want)


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(4)
    x = {n: rng.normal(size=(150, n)) for n in (3, 8)}
    rows = [(2 * i + j, x[n][i].tolist()) for j, n in enumerate((3, 8)) for i in range(150)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain(range(0, 300, 2), x[3]) | plain(range(1, 300, 2), x[8])
    for exact in (True, False):
        check(ann.search(d, F.col("id") % 50 == 0, exact=exact).collect(), want)


def test_recall_of_the_curves_alone(spark, tmp_path):
    """The windows find nine of ten true neighbours at random and in clusters, and a blurred query's own cluster."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    n = 50_000
    centres = rng.normal(size=(200, 64))
    for name, x in (("random", rng.normal(size=(n, 64))), ("clusters", centres[rng.integers(0, 200, n)] + rng.normal(size=(n, 64)) * 0.3)):
        x = x.astype("f4")
        pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}), tmp_path / f"{name}.parquet")
        got = ann.search(spark.read.parquet(str(tmp_path / f"{name}.parquet")), F.col("id") % 50 == 0, exact=False).collect()
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
        found = {}
        for r in got:
            found.setdefault(r.query_id, set()).add(r.vec_id)
        s = unit[::50] @ unit.T
        s[np.arange(len(s)), np.arange(0, n, 50)] = -2
        best = np.argpartition(-s, 5, axis=1)[:, :5]
        recall = np.mean([len(found[50 * k] & set(b.tolist())) / 5 for k, b in enumerate(best)])
        assert recall >= 0.9, (name, recall)
        print(name, "recall", recall)


def test_curves_decide_among_two_thousand_rows(spark, monkeypatch):
    chosen, windows = [], ann.windows
    monkeypatch.setattr(ann, "windows", lambda *a: chosen.append((windows(*a), a[5])) or chosen[-1][0])
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("id") % 50 == 0, exact=False).collect()
    t = e.toPandas()
    want = plain(t.vec_id.tolist(), np.array(t.embedding.tolist(), float))
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) / (5 * len(want)) >= 0.9
    (curves, reach), blocks = chosen[0]
    assert curves >= 2 and reach < blocks - 1  # a curve doesn't show a query at its end all blocks
    # clusters need few blocks
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.01
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("place", F.lit(0)).withColumn("curve", F.lit("a"))
    got = ann.search(d, F.col("id") % 50 == 0, exact=False).collect()
    want = plain(range(6000), x)
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) / (5 * len(want)) >= 0.9
    (curves, reach), blocks = chosen[1]
    assert blocks == 12 and 2 * reach + 1 < blocks

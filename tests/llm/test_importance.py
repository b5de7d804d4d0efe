from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tabmill.llm import importance, queries
from tests.llm import plain


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(text))
    return w, [zlib.crc32(g.encode()) % 10_000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain_resample(docs, target):
    """docs: (doc_id, text), target: texts."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[f] += 1
    total, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (total + 10_000) / ((s[k] + 1) * (aim + 10_000)))) for k in range(10_000)]
    out, long = [], []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        long += [out[-1]] if len(w) >= 20 else []
    for rank, row in enumerate(sorted(long, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 25 * len(long) // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = collected(queries.op12_importance_resampling(spark, sf))
    assert got == plain_resample(docs, target) and any(r[4] for r in got)


def test_odd_rows(spark):
    many = [(k % 40, f"{k} " * 25 + "Äh ÄH\x00x", "en", "a", 1) for k in range(80)]
    docs = spark.createDataFrame(plain.ODD + many, f"{plain.DOCS}").withColumnRenamed("lang", "weight").withColumnRenamed("source", "rank")
    target = spark.createDataFrame([(1, "ähm 3 äh 4 4"), (2, None)], "item_id long, text string")
    rows = [r[:2] for r in plain.ODD + many]
    assert collected(importance.resample(docs, target)) == plain_resample(rows, ["ähm 3 äh 4 4"])
    kept = importance.resampled(docs, target)
    ids = {r[0] for r in plain_resample(rows, ["ähm 3 äh 4 4"]) if r[4]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    assert importance.resample(docs.limit(0), target).count() == 0
    assert collected(importance.resample(docs, target.limit(0))) == plain_resample(rows, [])


def test_pieces_of_a_text_give_what_the_whole_does():
    text = "Alpha beta, GAMMA-delta 12 äöü " * 40 + "x" * 300 + " end"
    whole = importance.buckets_of(text)
    assert list(whole[1]) and sorted(whole[1]) == sorted(features(text)[1])
    for most in (1, 7, 50, 333):
        n, own = importance.buckets_of(text, most=most)
        assert n == whole[0] and np.array_equal(own, whole[1])
        assert "".join(importance.pieces(text, most)) == text

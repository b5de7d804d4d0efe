from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tabmill.llm import mixing, pii, queries, simhash, toxicity
from tabmill.llm.text import shared_table
from tests.llm import plain
from tests.llm.test_operators import check_pieces, ids_of
from tests.llm.test_simhash import groups, plain_fingerprint


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "personal data", "source mix", "packing"]

    # toxic documents go: those that op1's query predicts, no others
    kept = shared_table(stages["toxicity"](spark, docs, sf), "t")
    bad = {r.doc_id for r in queries.op1_toxicity(spark, sf).where("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad

    # one of each group stays, the first
    rows = kept.collect()
    first = {}
    for g, r in zip(groups([plain_fingerprint(r.text) for r in rows]), rows, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    single = shared_table(stages["near duplicates"](spark, kept, sf), "s")
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(first.values())

    # personal data is gone, the rest of each text stays
    masked = shared_table(stages["personal data"](spark, single, sf), "m")
    before = {r.doc_id: r.text for r in single.collect()}
    assert masked.columns == columns and masked.count() == len(before)
    for r in masked.collect():
        base = plain.personal(before[r.doc_id])
        assert not base or not plain.personal(r.text)
        assert base or r.text == before[r.doc_id] or "<" in r.text

    # the mix takes what op4 says of each document
    mixed = shared_table(stages["source mix"](spark, masked, sf), "x")
    took = {r.doc_id: r.taken for r in mixing.mix(masked).collect() if r.taken}
    sizes = mixed.select("doc_id", F.expr("size(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))").alias("n")).groupBy("doc_id").agg(F.sum("n")).collect()
    assert mixed.columns == columns and {r[0]: r[1] for r in sizes} == took

    # all tokens of the mix are packed, and run() ends there too
    packed = stages["packing"](spark, mixed, sf)
    total = sum(len(ids_of(r.text)) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == total
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(packed.collect())


def test_stages_on_odd_rows(spark, sf):
    docs = spark.createDataFrame(plain.ODD, plain.DOCS)
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = shared_table(stage(spark, d, sf), "o")
            assert d.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() >= 0

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tabmill.llm import queries, spotsigs
from tests.llm import plain


def plain_spots(text, anchors):
    w = plain.words((text or "").lower())
    out = {("^", *w[:2])} if w else set()
    for k, x in enumerate(w):
        if x in anchors:
            chain = [y for y in w[k + 1 :] if y not in anchors][:2]
            if len(chain) == 2:
                out.add((x, *chain))
    return out


def plain_compared(docs, anchors):
    """(doc_id, text) rows with distinct ids."""
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own = plain_spots(text, anchors)
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), len(own), len(plain_spots(edited, anchors)), jaccard(own, plain_spots(edited, anchors)), jaccard(own, plain_spots(after, anchors)))
    return out


def answers(df):
    rows = df.collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, len(r.fingerprint) // 16, len(r.edited_fingerprint) // 16, r.near_edited, r.near_next) for r in rows}
    assert len(got) == len(rows)
    return got


def agree(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4] and got[k][4:] == pytest.approx(w[4:]), k


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    anchors = spotsigs.common_words(docs)
    count = {}
    for r in docs.collect():
        for w in plain.words((r.text or "").lower()):
            count[w] = count.get(w, 0) + 1
    assert anchors == sorted(count, key=lambda w: (-count[w], w.encode()))[: spotsigs.ANCHORS]
    found = queries.op13_document_fingerprints(spark, sf)
    agree(answers(found), plain_compared([(r.doc_id, r.text) for r in docs.collect()], set(anchors)))
    rows = found.collect()
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_equal_texts_and_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "the A b the c"), (5, "THE a B the c"), (4, "of"), (None, "zé of ü the"), (3, "the " * 2_000 + "end of it all"), (-(1 << 63), "least of all the ids"), ((1 << 63) - 1, "largest of all the ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("x")).withColumn("near_next", F.lit(1))
    found = spotsigs.compared(docs, ["the", "of"])
    agree(answers(found), plain_compared(rows, {"the", "of"}))
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    assert prints[6] == prints[5] and prints[9] == prints[8] == prints[7] == ""
    assert spotsigs.compared(docs.limit(0)).count() == 0
    one = spotsigs.compared(docs.where("doc_id = 3"), ["the", "of"]).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # rows that repeat
    twice = spotsigs.compared(docs.unionByName(docs.where("doc_id in (5, 6)")), ["the", "of"])
    assert twice.count() == len(rows) + 2 and twice.where("doc_id = 6 and near_next = 1").count() == 2 and twice.where("doc_id = 5 and near_next = 1").count() == 1
    assert spotsigs.compared(docs, []).count() == len(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_matches_against_all_pairs(spark, threshold):
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(80):
        w = list(base)
        for j in range(k % 20):
            w[(7 * j + k) % 60] = f"x{k}-{j}" if k % 3 else f"x{j}"
        texts[k] = " the ".join(w[: 60 - k % 11])
    texts |= {100: "", 101: " ", 102: "alone"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = spotsigs.fingerprints(docs, ["the"])
    sets = {k: plain_spots(t, {"the"}) for k, t in texts.items()}
    want = {}
    for q in (k for k in texts if k % 5 == 0):
        for k in texts:
            both = sets[q] | sets[k]
            j = len(sets[q] & sets[k]) / len(both) if both else 1.0
            if j >= threshold:
                want[q, k] = j
    got = {(r.query_id, r.doc_id): r.likeness for r in spotsigs.matches(prints.where("doc_id % 5 = 0"), prints, threshold).collect()}
    assert got.keys() == want.keys() and len(want) > 50 and all(got[k] == pytest.approx(want[k]) for k in want)

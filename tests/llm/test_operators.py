from __future__ import annotations

import collections
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabmill.llm import ann, histogram, langmodel, mixing, packing, pii, quality, queries, simhash, tokens, toxicity
from tabmill.llm.text import bounded_sample
from tests.llm import plain


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(plain.ODD, plain.DOCS).selectExpr("*", "1 size", "2 n", "3 fp", "4 cell", "5 score")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (4, 0, 1), (5, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


# ---- toxicity


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    sizes = [1, 2, 300, 7, 1, 64, 65]
    odds = rng.normal(0, 4, sum(sizes))
    starts = np.zeros(len(odds), bool)
    starts[np.cumsum([0, *sizes])[:-1]] = True
    want = [x for part in np.split(odds, np.cumsum(sizes)[:-1]) for x in plain.forward_backward(part, trans)]
    for width in (4, 64):
        assert np.allclose(toxicity.forward_backward(odds, starts, trans, width), want, atol=1e-9)
    tiny = plain.forward_backward(odds[:2], trans)  # against all four sequences
    weight = {s: math.exp(sum(o for o, y in zip(odds[:2], s, strict=True) if y) + trans[s[0]][s[1]]) for s in itertools.product((0, 1), repeat=2)}
    assert np.allclose(tiny, [sum(v for s, v in weight.items() if s[k]) / sum(weight.values()) for k in (0, 1)])


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert sum(r.predicted for r in got if r.toxic) > 0.8 * sum(r.toxic for r in got)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 and plain.fold(r.doc_id, 5) == 0 for r in got)


def test_window_expectations_are_exact():
    """Marginals and expected pairs of short chains of mixed lengths, against all state sequences."""
    rng = np.random.default_rng(1)
    size, trans = np.array([1, 3, 5, 2]), rng.normal(size=(2, 2))
    odds = rng.normal(0, 2, size.sum())
    p, pairs = toxicity.expectations(odds, size, trans)
    want_p, want_pairs = [], np.zeros((2, 2))
    for part in np.split(odds, np.cumsum(size)[:-1]):
        one, two, total = np.zeros(len(part)), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=len(part)):
            w = math.exp(sum(o for o, v in zip(part, y, strict=True) if v) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            one += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        want_p += list(one / total)
        want_pairs += two / total
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_toxicity_scores_are_the_plain_ones(spark):
    """Scores and offsets of every document against a word-by-word forward-backward under the same model."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = queries.fitted_toxicity(d, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    some = 0
    for doc in docs:
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", doc.text or "")]
        odds = [model["weight"][toxicity.cells(w.encode().lower())].sum() + model["bias"][0] for _, _, w in found]
        p = plain.forward_backward(odds, model["trans"])
        near = [x for x in p if x >= toxicity.LEAST]
        none = sum(math.log1p(-min(x, 1 - 1e-12)) for x in near)
        a = min(12.0, max(-12.0, math.log(max(-math.expm1(none), 1e-12)) - none))
        score = 1 / (1 + math.exp(-(a * model["slope"][0] + math.log1p(sum(near)) * model["slope"][1] + model["level"][0])))
        assert math.isclose(got[doc.doc_id].score, score, abs_tol=1e-6)
        want = []
        for k, ((i, j, _), x) in enumerate(zip(found, p, strict=True)):
            if x >= 0.5:
                if want and k and p[k - 1] >= 0.5:
                    want[-1] = (want[-1][0], j)
                else:
                    want.append((i, j))
        assert [tuple(x) for x in got[doc.doc_id].spans] == want
        some += bool(want)
    assert some > 3


def test_toxicity_of_a_repeated_row(spark):
    """A hundred thousand rows of one labelled id are one document to learn from, and a row each in the result."""
    text = "the same zork text again and again"
    d = spark.range(100_000).selectExpr("1 doc_id", f"'{text}' text").unionByName(spark.range(2, 60).selectExpr("id doc_id", "if(id % 2 = 0, 'a zork and a blarg', 'a calm day') text"))
    y = spark.range(1, 60).selectExpr("id doc_id", "cast(id % 2 = 0 as int) toxic")
    model = toxicity.fit(d, y)
    assert toxicity.score(d.withColumn("score", F.lit("x")).withColumn("spans", F.lit(1)), model).groupBy("doc_id").count().where("count = 100000").count() == 1


def test_toxic_spans(spark, odd, labels):
    clean, bad = "the day was long and dull as ever before", "you are a total zork and a vile blarg my friend"
    rows = [(k, bad.replace("vile", f"w{k}") if k % 3 == 0 else clean.replace("day", f"d{k}"), k % 3 == 0) for k in range(150)]
    d = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(k, int(x)) for k, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    assert all((r.score >= 0.5) == rows[r.doc_id][2] == bool(r.predicted) for r in toxicity.score(d, model).collect())
    one = spark.createDataFrame([(1, "ü the day zork blarg was long")], "doc_id long, text string")
    (span,) = toxicity.spans(one, model).first().spans
    assert "ü the day zork blarg was long".encode()[span.start : span.end] == b"zork blarg"
    got = toxicity.score(odd.select("doc_id", "text", "n"), model).collect()
    assert len(got) == len(plain.ODD) and all(r.predicted == int(r.score >= 0.5) for r in got) and not any(r.predicted for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.without_toxic(odd, model).count() == sum(1 - r.predicted for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(odd, labels)
    assert none == {"ready": False} and {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


# ---- language model


def test_language_model(spark, sf, docs):
    rows = queries.op2_language_model(spark, sf).collect()
    w = {d.doc_id: [*plain.words(plain.lower(d.text)), "<end>"] for d in docs}
    held = {k: plain.fold(k, 7) == 2 for k in w}
    c = collections.Counter(x for k, v in w.items() if not held[k] for x in v)
    n, v = sum(c.values()), len(c)
    assert sorted(r.doc_id for r in rows) == sorted(w)
    for r in rows:
        own = w[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        assert r.score < 0


def test_language_model_is_normalised_and_joins_the_tail(spark, monkeypatch):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c a b", "b a", "zz yy xx", "a zz", None, ""] * 4)], "doc_id long, text string")
    whole = {r.doc_id: r for r in langmodel.fit_and_score(d, F.col("doc_id") % 7 == 6).collect()}
    model, words, counts = langmodel.fit(d.where("doc_id % 7 <> 6").select("text"))
    n = langmodel.OWN + langmodel.CELLS
    h = np.random.default_rng(0).integers(0, langmodel.OWN + langmodel.HASHED + 1, (3, langmodel.CONTEXT))
    ready = langmodel.Normalised(model)
    total = sum(np.exp(ready.logs(np.full(3, k), h)) for k in range(n))
    assert np.allclose(total, 1, atol=1e-5)
    # each group's words and its unseen share sum to one
    c = np.array([r.c for r in counts.collect()])
    assert words.total == c.sum() and words.distinct == len(c)
    # the words of a class, with one that isn't known, sum to one
    by = {r.word: r.c for r in counts.collect()}
    own = sorted(by, key=lambda w: (-by[w], w))[: langmodel.OWN]
    for k in range(langmodel.CELLS):
        inside = [by[w] + 1 for w in by if w not in own and langmodel.cell(bytes(w)) == k]
        assert words.room[k] == sum(inside) + 1
    monkeypatch.setattr(langmodel, "HEAD", 2)  # nearly all words by join: the base doesn't change
    for r in langmodel.fit_and_score(d, F.col("doc_id") % 7 == 6).collect():
        assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known) and math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)


def plain_score(text, model, by, own):
    """log10 of a text's probability, word by word. by: counts of the words learned from; own: those that are classes."""
    L = langmodel
    place = {w: k for k, w in enumerate(own)}
    vector = lambda w: place[w] if w in place else L.OWN + zlib.crc32(w) % L.HASHED
    room = collections.Counter({k: 1 for k in range(L.CELLS)})
    for w, c in by.items():
        if w not in place:
            room[zlib.crc32(w[-3:]) % L.CELLS] += c + 1
    seq, total = [*(x.encode() for x in plain.words(plain.lower(text))), b""], 0.0
    for k, w in enumerate(seq):
        before = [vector(seq[k - j]) if k >= j else L.OWN + L.HASHED for j in range(1, L.CONTEXT + 1)]
        guess = sum(model["place"][j].astype(float) * model["r"][b] for j, b in enumerate(before))
        s = model["q"][:, :-1].astype(float) @ guess + model["q"][:, -1]
        y = place[w] if w in place else L.OWN + zlib.crc32(w[-3:]) % L.CELLS
        total += (s[y] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
        if w not in place:
            total += math.log10((by.get(w, 0) + 1) / room[y - L.OWN])
    return total


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_normalised_is_the_softmax(scale):
    """Products of exponentials, or sums where they could overflow, against a softmax in double precision."""
    rng, L = np.random.default_rng(1), langmodel
    model = {k: (x + rng.normal(0, 0.3, x.shape)).astype("f4") * np.float32(scale if k == "q" else 1) for k, x in L.fresh(np.full(L.OWN + L.CELLS, 1 / 320)).items()}
    h, y = rng.integers(0, L.OWN + L.HASHED + 1, (700, L.CONTEXT)), rng.integers(0, L.OWN + L.CELLS, 700)
    wide = {k: x.astype(float) for k, x in model.items()}
    s = sum(wide["r"][h[:, k]] * wide["place"][k] for k in range(L.CONTEXT)) @ wide["q"][:, :-1].T + wide["q"][:, -1]
    s -= s.max(1, keepdims=True)
    ready = L.Normalised(model)
    assert ready.safe == (scale == 1)
    assert np.allclose(ready.logs(y, h), s[np.arange(700), y] - np.log(np.exp(s).sum(1)), rtol=1e-4, atol=1e-3)


def test_language_model_scores_are_the_plain_ones(spark, sf, docs, monkeypatch):
    """Every document's score against a word-by-word sum under the same model; words by the head and by join alike."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(2)
    d = d.unionByName(spark.createDataFrame([(10**6, "unheard qqqq of words qqqq"), (10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string"))
    for head in (langmodel.HEAD, 300):
        monkeypatch.setattr(langmodel, "HEAD", head)
        held = F.col("doc_id") % 7 == 2
        model, words, counts = langmodel.fit(d, ~held)
        by = {bytes(r.word): r.c for r in counts.collect() if r.c}
        texts = {r.doc_id: r.text for r in d.collect()}
        own = [w for w, k in words.place.items() if k < langmodel.OWN and words.known[k]]
        assert own == sorted(own, key=lambda w: (-by[w], w)) and len(own) > 100
        for r in langmodel.score(d, model, words, counts).where("doc_id % 5 = 2 or doc_id >= 1000000").collect():
            assert math.isclose(r.score, plain_score(texts[r.doc_id], model, by, own), rel_tol=1e-4, abs_tol=1e-3), r


def test_language_model_does_not_depend_on_partitions(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(langmodel, "SHARD", 20_000)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    one, many = ({r.doc_id: r for r in langmodel.fit_and_score(x, held).collect()} for x in (d.coalesce(1), d.repartition(16)))
    assert one.keys() == many.keys() and one[next(iter(one))].train_tokens > 3 * langmodel.SHARD
    for k, r in one.items():
        assert abs(r.score - many[k].score) <= 1e-4 * r.n_tokens


def test_language_model_odd_joins(spark):
    """A word that only held-out rows have, in a hundred thousand of them, is in the head that goes to all tasks."""
    d = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 2, "onlyhere onlyhere").otherwise("a b").alias("text"))
    held = F.col("doc_id") % 7 == 2
    model, words, counts = langmodel.fit(d, ~held)
    assert b"onlyhere" in words.place and not words.known[words.place[b"onlyhere"]]
    got = langmodel.score(d, model, words, counts).groupBy("n_known", "n_tokens").count().collect()
    assert sorted((r.n_known, r.n_tokens) for r in got) == [(1, 3), (3, 3)] and sum(r["count"] for r in got) == 100_000


def test_language_model_learns_contexts(spark):
    rng = np.random.default_rng(0)
    tongue = lambda k: " ".join(f"{'ab'[k]}{x}" for x in rng.integers(0, 30, 80))
    d = spark.createDataFrame([(k, tongue(k % 2)) for k in range(400)], "doc_id long, text string")
    got = langmodel.fit_and_score(d, F.col("doc_id") % 5 == 0).where("held_out").collect()
    assert all(r.score > r.base_score + 10 for r in got)  # knowing the tongue saves near log10(2) a word


def test_language_model_odd_rows(spark, odd):
    got = langmodel.fit_and_score(odd.select("doc_id", "text", "n", "score"), F.coalesce(F.col("doc_id") == 6, F.lit(False))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 60_001), (6, 7)]
    assert langmodel.fit_and_score(odd.limit(0), F.lit(False)).count() == 0
    none = langmodel.fit_and_score(odd.select("doc_id", "text"), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)}


# ---- quality


def test_quality(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    cells = {}
    for d in docs:
        h = [_xx(w.encode()) for w in plain.words(d.text)]
        cells[d.doc_id] = [x % quality.BUCKETS for x in [*h, *(pair_of(a, b) for a, b in zip(h, h[1:], strict=False))]]
    raw, target = collections.Counter(x for v in cells.values() for x in v), collections.Counter(x for k, v in cells.items() if k in good for x in v)
    share = sum(target.values()) / sum(raw.values())
    ratio = {x: math.log((target[x] + quality.PRIOR) / (raw[x] * share + quality.PRIOR)) for x in raw}
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.base_rules(d.text)
        mean = sum(ratio[x] for x in cells[d.doc_id]) / max(1, len(cells[d.doc_id]))
        assert math.isclose(r.mean_ratio, mean, abs_tol=1e-9) and r.kept == (not r.base_failed and mean >= quality.THRESHOLD)


_HASHES: dict = {}


def _xx(data: bytes, seed: int = 42) -> int:
    import xxhash

    v = xxhash.xxh64_intdigest(data, seed)
    return v - 2**64 if v >= 2**63 else v


def pair_of(a, b):
    """The hash of two numbers, the first one's hash being the second one's seed, as Spark chains them."""
    if (a, b) not in _HASHES:
        _HASHES[a, b] = _xx(struct.pack("<q", b), _xx(struct.pack("<q", a)) % 2**64)
    return _HASHES[a, b]


def test_trusted_ids_by_broadcast_or_shuffle(spark, sf):
    d, good = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    a, b = (quality.fit_ratio(d, good, 64, spread=k).first().model for k in (quality.SPREAD, 0))
    assert a == b and any(a)


def test_quality_odd_rows(spark, odd, labels):
    rows = quality.quality(odd, bounded_sample(labels, "quality", {1: 10})).collect()
    want = sorted(((d[0] or 0), *plain.base_rules(d[1])) for d in plain.ODD)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality(odd.limit(0), labels.where("false")).count() == 0
    assert {r.mean_ratio for r in quality.quality(odd, labels.where("false")).collect()} == {0.0}


# ---- mixing


def test_mix(spark, sf, docs):
    rows = queries.op4_source_mix(spark, sf).collect()
    again = queries.op4_source_mix(spark, sf).collect()
    assert sorted(rows) == sorted(again) and sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    own = {d.doc_id: d.source for d in docs}
    sizes = collections.Counter()
    for d in docs:
        sizes[d.source] += len(plain.words(d.text))
    want, taken = plain.fill_targets(sizes), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[own[r.doc_id]] and math.isclose(r.target, want[own[r.doc_id]], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[own[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 200 for s in want)


def test_mix_caps_and_odd_rows(spark, odd):
    rows = mixing.mix(odd, block=8, shard=100).collect()
    sizes = collections.Counter()
    for d in plain.ODD:
        sizes[d[3]] += len(plain.words(d[1]))
    want = plain.fill_targets(sizes)
    assert len(rows) == len(plain.ODD) and sum(r.size for r in rows) == sum(sizes.values())
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    assert all(r.taken <= 3 * r.size for r in rows) and all(r.taken == 0 for r in rows if not r.size)
    mixed = mixing.mixed_documents(odd.select(*[c.split()[0] for c in plain.DOCS.split(", ")]), block=8, shard=100)
    by = collections.Counter()
    for r in mixed.collect():
        by[r.doc_id] += len(plain.words(r.text))
        assert r.n_chars == len(r.text)
    took = collections.Counter()
    for r in rows:
        took[r.doc_id] += r.taken
    assert {k: v for k, v in took.items() if v} == dict(by)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd.where("doc_id < 3")).count() == 2


def test_mix_reaches_small_targets(spark):
    rows = [(k, "w " * 40, f"s{k:03}") for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target, taken = collections.Counter(), collections.Counter()
    for r in got:
        target[r.doc_id % 3] += r.target
        taken[r.doc_id % 3] += r.taken
    assert all(abs(taken[k] / target[k] - 1) < 0.1 for k in target), (target, taken)
    rows = [(0, "w " * 10, "a"), (1, "w " * 40, "b"), (2, "w " * 20_000, "c")]  # a and b stop at three times their size
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5.0, 5.0, 1.0), shard=100).collect()
    assert sorted((r.source_size, r.target, r.taken) for r in got)[:2] == [(10, 30.0, 30), (40, 120.0, 120)]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(4)).alias("q")).collect()
    assert sorted(r.p for r in d) == sorted(r.q for r in d) == list(range(n))
    assert n < 1000 or [r.p for r in d] != [r.q for r in d]


# ---- packing and counts


def ids_of(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    if "t" not in _HASHES:
        _HASHES["t"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _HASHES["t"].encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, texts, length=2048):
    ids = {k: np.array([*ids_of(t), 1], "<u4") for k, t in texts.items()}
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert at == {k: len(v) for k, v in ids.items()}
    used = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert all(n <= length and n & (n - 1) == 0 for n in used.values())


@pytest.mark.parametrize("text", ["one <|endoftext|> two", "a" + " " * 1_200_000 + "b", "\n" * 1_200_000, "a b\u00a0" * 1000 + "\u2003\t" * 600_000 + "\x1c" * 200_000 + "c"])
def test_ids_are_those_of_the_tokenizers_file(text):
    assert tokens.encode(text) == ids_of(text)


def test_packing(spark, sf, docs):
    check_pieces(queries.op5_mixture_packing(spark, sf).collect(), {d.doc_id: d.text for d in docs})


def plain_rounds(sizes, weights, groups, window):
    """Tokens of each source in each window: one token at a time goes to the source that is furthest behind its weight."""
    total, left, dealt, order = sum(sizes.values()), dict(sizes), {s: 0 for s in sizes}, []
    while any(left.values()):
        live = [s for s in left if left[s] and weights[s] > 0] or [s for s in left if left[s]]
        s = min(live, key=lambda s: ((dealt[s] + 0.5) / (weights[s] or sizes[s]), s))
        order.append(s)
        dealt[s] += 1
        left[s] -= 1
    out = []
    for g in range(groups):
        own = order[total * g // groups : total * (g + 1) // groups]
        out += [(g, k // window, collections.Counter(own[k : k + window])) for k in range(0, len(own), window)]
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, None: 1.0}, {"b": 1.0, "absent": 5.0}])
def test_packing_keeps_proportions_over_groups(spark, weights):
    rng = np.random.default_rng(1)
    rows = [(k, "word " * int(rng.integers(1, 400)), "ab"[int(k % 5 == 0)] if k % 11 else None) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(d, length=256, window=4, group=20_000, weights=weights).collect()
    check_pieces(got, {k: t for k, t, _ in rows}, 256)
    own = {k: s for k, _, s in rows}
    sizes, window = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in got:
        sizes[own[r.doc_id]] += r.length
        # windows follow each other inside a group; its last one has sequences of powers of two
        window[r.sequence_id >> 32, min((r.sequence_id & 0xFFFFFFFF) // 4, sum(sizes.values()))][own[r.doc_id]] += r.length
    groups = 1 + max(g for g, _ in window)
    target = {s: sizes[s] if weights is None else weights.get(s, 0.0) for s in sizes}
    want = plain_rounds({str(s): n for s, n in sizes.items()}, {str(s): w for s, w in target.items()}, groups, 1024)
    full = [(g, k, c) for g, k, c in want if sum(c.values()) == 1024]
    assert groups > 5 and len(full) > 60
    for g, k, c in full:
        assert sum(window[g, k].values()) == 1024
        assert all(abs(window[g, k][s] - c[str(s)]) <= 3 for s in sizes), (g, k, window[g, k], c)
    if weights is None:  # every window holds the shares
        for w in window.values():
            n = sum(w.values())
            assert n < 1024 or all(abs(w[s] / n - sizes[s] / sum(sizes.values())) < 0.01 for s in sizes)


def test_mixed_documents_tell_rows_apart_by_where_a_null_stands(spark):
    rows = [(1, "one two three", "en", None, 13), (1, "one two three", None, "en", 13), (2, "four five six", "de", "en", 13)]
    docs = spark.createDataFrame(rows, plain.DOCS)
    got = {(r.lang, r.source) for r in mixing.mixed_documents(docs, passes=3).where("doc_id = 1").collect()}
    assert got <= {("en", None), (None, "en")} and mixing.sized(docs).select("_h").distinct().count() == 3
    both = [r for r in mixing.mixed_documents(docs, weights=(1.0,), passes=3).collect() if r.doc_id == 1]
    took = {(r.source, r.doc_id): r.taken for r in mixing.mix(docs, weights=(1.0,)).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()}
    assert sum(len(r.text.split()) for r in both) == sum(r.taken for r in mixing.mix(docs, weights=(1.0,)).where("doc_id = 1").collect()) and took
    # of two rows of one id that differ by where a null stands, the near-duplicate stage keeps one, whole
    kept = simhash.first_of_each(docs).where("doc_id = 1").collect()
    assert [tuple(r) in rows for r in kept] == [True]


def test_packing_odd_rows(spark, odd):
    got = packing.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    check_pieces(got, {d[0]: d[1] for d in plain.ODD if d[0] is not None})
    assert packing.pack(odd).agg(F.sum("length")).first()[0] == sum(len(ids_of(d[1])) + 1 for d in plain.ODD)
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_counts(spark, sf, docs, odd):
    for rows, texts in ((queries.op7_token_counts(spark, sf).collect(), [d.text for d in docs]), (histogram.histogram(odd).collect(), [d[1] for d in plain.ODD])):
        n = [len(ids_of(t)) for t in texts]
        assert sorted((r.length, r.n_docs) for r in rows) == sorted(collections.Counter(n).items())
        for r in rows:
            assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length))
            assert (r.truncated_total, r.total_docs, r.total_tokens) == (sum(min(x, r.length) for x in n), len(n), sum(n))
            assert math.isclose(r.docs_up_to, sum(x <= r.length for x in n) / len(n))
    h = histogram.histogram(odd)
    n = sorted(len(ids_of(d[1])) for d in plain.ODD)
    assert [histogram.truncated_total(h, k).first()[0] for k in (0, 5, 10**6)] == [sum(min(x, k) for x in n) for k in (0, 5, 10**6)]
    assert histogram.quantile(h, 0.5).first()[0] == n[len(n) // 2 - 1]
    none = histogram.histogram(odd.limit(0))
    assert none.count() == 0 and histogram.truncated_total(none, 5).first()[0] == 0 and histogram.quantile(none, 0.5).first()[0] is None


# ---- personal data


def test_personal_data(spark, sf, docs, odd):
    model = pii.fit(odd.select("doc_id", "text"))
    for rows, texts in ((queries.op9_personal_data(spark, sf).collect(), [(d.doc_id, d.text) for d in docs]), (pii.find(odd.select("doc_id", "text", "n"), model).collect(), [d[:2] for d in plain.ODD])):
        want = sorted((k or 0, *([x[1] for x in s].count(j) for j in range(4)), plain.digest(s)) for k, t in texts for s in [plain.personal(t)])
        assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
        spans = {r.doc_id: set(filter(None, r.spans.split(","))) for r in rows}
        assert all({f"{plain.KINDS[k]}:{a}:{b}" for a, k, b in plain.personal(t)} <= spans[i] for i, t in texts)
    assert pii.find(odd.limit(0).select("doc_id", "text"), model).count() == 0
    masked = {r.doc_id: r for r in pii.redacted(spark.createDataFrame(plain.ODD, plain.DOCS), model).collect()}
    assert masked[6].text == "Ünïcödé mail <EMAIL> <PHONE>" and masked[6].n_chars == len(masked[6].text) and masked[1].text is None


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y a@b..c é@b.cd a.b+c@d-e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.256 01.2.3.255.", "4058 8265-8863 4783 12345 " + "9" * 40, "+1 (383) 555-6083 +12 +1-2 ++49 30 1234567) +1 (2 ", "", "0" * 5000 + "@" + "." * 50])
def test_base_spans(text):
    assert pii.base_spans(text) == plain.personal(text)


def test_loopy_marginals_are_exact_on_trees():
    rng = np.random.default_rng(2)
    unary, pair, edges = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    p = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = math.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for k, v in enumerate(y):
            p[k, v] += w
    assert np.allclose(pii.marginals(unary, edges, pair, 40), p / p.sum(1, keepdims=True), atol=1e-6)


def test_skip_links_carry_labels():
    """A number that stands alone is left out; beside sure mentions of the same number in the document it is added."""
    unary = np.zeros((pii.CELLS, pii.LABELS))
    sign, lone = pii.features("+555-123-4567", "a", "a"), pii.features("555-123-4567", "a", "a")
    unary[sign[2], 3] = 8.0  # the shape with a plus sign is a phone number's
    unary[lone[0], pii.OUTSIDE] = 1.0
    model = {"unary": unary, "chain": np.zeros((pii.LABELS, pii.LABELS)), "same": np.array([3.0, 0.0])}
    lone = "call to 555-123-4567 now ok"
    both = "call to +555-123-4567 now ok and then call to 555-123-4567 now ok and again call to +555-123-4567 now ok"
    assert pii.label_batch([lone], model, sure=0.5) == [[]]
    found = pii.label_batch([both, lone], model, sure=0.5)
    assert (both.index(" 555") + 1, 3, both.index(" 555") + 13) in found[0] and found[1] == []
    base, every = pii.all_spans([both], model, sure=0.5)[0]
    assert set(base) < set(every)


def test_added_spans_are_the_plain_ones(spark, docs):
    """The field's own spans against message passing on dictionaries, document by document, under the same weights."""
    rng = np.random.default_rng(6)
    model = {"unary": rng.normal(0, 1.5, (pii.CELLS, pii.LABELS)), "chain": rng.normal(0, 0.5, (pii.LABELS, pii.LABELS)), "same": np.array([1.5, 0.0])}
    texts = [d.text for d in docs if d.text] + ["call 555-123-4567 or 555-123-4567 and a@b.cd, x@b.cd 12 12 12"]
    texts += [" ".join(str(x) if x % 3 else f"w {x % 7} and {x}-{x % 10}" for x in rng.integers(10**6, 10**6 + 9, 6).tolist()) for _ in range(30)]
    got, some = pii.all_spans(texts, model, sure=0.5), 0
    for text, (base, every) in zip(texts, got, strict=True):
        want = [s for s in plain_field(text, model, 0.5) if all(s[2] <= a or s[0] >= b for a, _, b in base)]
        assert base == plain.personal(text) and every == sorted(base + want)
        some += len(want)
    assert some > 20


def plain_field(text, model, sure):
    found, feats, chain, skip = pii.graph(text)
    labels = range(pii.LABELS)
    own = [[sum(model["unary"][f][y] for f in fs) for y in labels] for fs in feats]
    together = [[model["same"][0] * (a == b) for b in labels] for a in labels]
    sides = {}
    for some, table in ((chain, model["chain"]), (skip, together)):
        for a, b in some:  # an edge may stand twice, once of each kind
            sides[a, b, table is together] = [[table[x][y] for y in labels] for x in labels]
            sides[b, a, table is together] = [[table[y][x] for y in labels] for x in labels]
    into = {}
    for a, b, kind in sides:
        into.setdefault(b, []).append((a, b, kind))
    say = {e: [0.0] * pii.LABELS for e in sides}
    for _ in range(pii.ROUNDS):
        new = {}
        for a, b, kind in sides:
            before = [own[a][x] + sum(say[e][x] for e in into.get(a, ()) if e != (b, a, kind)) for x in labels]
            out = [max(before[x] + sides[a, b, kind][x][y] for x in labels) + math.log(sum(math.exp(before[x] + sides[a, b, kind][x][y] - max(before[z] + sides[a, b, kind][z][y] for z in labels)) for x in labels)) for y in labels]
            new[a, b, kind] = [0.5 * say[a, b, kind][y] + 0.5 * (out[y] - max(out)) for y in labels]
        say = new
    spans = []
    for k, (a, b, _) in enumerate(found):
        total = [own[k][y] + sum(say[e][y] for e in into.get(k, ())) for y in labels]
        p = np.exp(np.array(total) - max(total))
        p /= p.sum()
        if p.argmax() != pii.OUTSIDE and p.max() >= sure:
            spans.append((a, int(p.argmax()), b))
    return spans


def test_a_repeated_row_is_learned_from_once(spark):
    """Wherever its hash lies among the others', it doesn't fill the sample."""
    d = spark.createDataFrame([(k, f"call +1 555 010 {k:04d} or write to user{k}@example.org, part 77{k}") for k in range(30)], "doc_id long, text string")
    one = pii.fit(d, sample_docs=10)
    for k in range(0, 30, 3):
        more = pii.fit(d.union(d.where(F.col("doc_id") == k).crossJoin(spark.range(20)).select("doc_id", "text")), sample_docs=10)
        assert all(np.array_equal(one[x], more[x]) for x in one)


def test_long_words_take_linear_time(spark):
    import time

    began = time.time()
    for text in ("x" * 1_000_000, "x" * 500_000 + "1" + "y" * 499_999, "1" * 1_000_000, "a@" * 300_000):
        pii.graph(text)
        pii.base_spans(text)
    assert time.time() - began < 30
    d = spark.createDataFrame([(1, "x" * 1_000_000 + " a@b.cd", 1, "s")], "doc_id long, text string, n_email int, spans string")
    (r,) = pii.find(d, pii.fit(d.select("doc_id", "text"))).collect()
    assert (r.n_email, r.spans) == (1, "email:1000001:1000007") and len(r) == 8


def test_a_row_a_hundred_thousand_times(spark):
    """Copies of one row are dealt over all groups and cells, and each gets its result."""
    n = 100_000
    d = spark.range(n, numPartitions=8).selectExpr("cast(null as long) doc_id", "'one two three four five' text", "'a' source", "'en' lang", "1L n_chars")
    d = d.unionByName(spark.range(100).selectExpr("id doc_id", "concat('six seven ', id) text", "'b' source", "'en' lang", "1L n_chars"))
    got = packing.pack(d, length=64, window=4, group=20_000)
    assert got.where("doc_id is null").agg(F.sum("length")).first()[0] == n * (len(ids_of("one two three four five")) + 1)
    by = got.groupBy(F.shiftright("sequence_id", 32)).agg(F.sum("length").alias("n")).collect()
    assert len(by) > 20 and max(r.n for r in by) < 40_000
    mixed = mixing.mix(d, block=8, shard=100)
    size = mixed.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("taken").alias("most"), F.max("target").alias("target")).where("doc_id is null").first()
    assert (size.size, size.n) == (5, n) and size.most <= 15 and abs(size.t / size.target - 1) < 0.01

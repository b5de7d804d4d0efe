"""Toxic spans and document scores from a linear-chain conditional random field over words.

Labels are of documents, so words are labelled first: over a bounded sample of labelled documents, each word's own form and
its beginnings (4 to 6 characters) are counted by the documents' labels, and a word of a toxic document is toxic if one of its
forms is tied to that label beyond chance. The field (states: clean, toxic) is trained on windows of those documents: hashed
weights for a word's form, beginnings and endings, and transition weights, by gradient ascent on the exact likelihood. Scoring
takes every word of every text: forward-backward marginals, from which a logistic function of the document's aggregates (the
log odds that any word is toxic, and the expected number of toxic words) gives its score. Words whose marginal is below
`LEAST` don't count there, so that a long text's many small doubts don't add up. Words are lower-cased and lose the
punctuation at their ends; nothing but the text enters a score. Runs of words whose marginal is one half or more are the
offending spans.

Bounds of what is learned from, and nothing else: SAMPLE labelled documents, one row for each id; of each document, WINDOWS
windows around toxic words, those whose places hash lowest wherever they stand, and as many at even steps.

Cases: null and empty texts have no words and get the score of a document without toxic words. Rows that repeat and null ids
are scored alone (a null id is never learned from). An empty table gives no rows. If no label can be learned from, all scores
are 0. Very long texts are read whole: the chain is cut into blocks that are joined exactly. Other columns pass through, but
those named score, predicted or spans give way where these are made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import bounded_sample, by_bytes, others, shared_table

#: Most labelled documents that are learned from, by label.
SAMPLE = {1: 3000, 0: 6000}
#: Least log-likelihood ratio of a form's tie to the label.
TIE = 10.0
#: Least marginal of a word that counts for its document. (Held out at sf0.1: accuracy 0.989, log loss 0.056; without it 0.987, 0.062.)
LEAST = 0.2
CELLS = 1 << 16
FORMS = 8
WINDOW = 24
WINDOWS = 3
#: Windows whose likelihood is summed at once.
PART = 8192
CACHE = 200_000
#: Bytes of texts that are scored at once.
RUN = 4_000_000
EDGE = b".,;:!?()[]{}<>\"'"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def forms(word: bytes) -> list[bytes]:
    """What stands for a word in the count by labels: the word and its beginnings."""
    w = word.strip(EDGE).decode("utf-8", "replace")
    return [x.encode() for x in dict.fromkeys([w, *(w[:k] for k in (4, 5, 6) if len(w) > k)]) if len(x) > 2]


def cells(word: bytes) -> list[int]:
    """The word's cells among the weights; always FORMS of them."""
    w = word.strip(EDGE).decode("utf-8", "replace")
    names = ("=" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "6" + w[:6], "e" + w[-3:], "E" + w[-4:], "n%d" % min(len(w), 12))
    return [zlib.crc32(x.encode()) % CELLS for x in names]


def forward_backward(odds: np.ndarray, starts: np.ndarray, trans: np.ndarray, width: int = 64) -> np.ndarray:
    """The marginal of state 1 at each place of many chains laid end to end.

    odds: log of state 1 over state 0, by place. starts: true at a chain's first place. trans: (2, 2) logs. The places are cut
    into rows of `width`; products of step matrices run along all rows at once, then over the rows, then back into them, so
    the work is in proportion to the places and long chains cost no more than short ones.
    """
    n = len(odds)
    if not n:
        return np.zeros(0)
    width = max(width, int(np.sqrt(n)))
    rows = -(-n // width)
    pad = rows * width - n
    o = np.concatenate([odds, np.zeros(pad)]).reshape(rows, width)
    first = np.concatenate([starts, np.ones(pad, bool)]).reshape(rows, width)
    t = np.exp(trans - trans.max())
    e = np.exp(np.stack([np.minimum(0, -o), np.minimum(0, o)], -1))  # emissions, the larger one 1
    forget = np.full((2, 2), 0.5)  # a chain's start doesn't depend on what came before

    def run(emit: np.ndarray, cut: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Messages after each place, (rows, width, 2), for steps: old state -> new state, then emission."""
        into = np.where(cut[..., None, None], forget, step)  # into[i, j]: from i to j
        total = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
        for k in range(width):
            total = (total @ into[:, k]) * emit[:, k, None, :]
            total /= total.sum((1, 2), keepdims=True)
        state = np.full(2, 0.5)
        at = np.empty((rows, 2))
        for r in range(rows):
            at[r] = state
            state = state @ total[r]
            state /= state.sum()
        out = np.empty((rows, width, 2))
        for k in range(width):
            at = np.einsum("ri,rij->rj", at, into[:, k]) * emit[:, k]
            at /= at.sum(1, keepdims=True)
            out[:, k] = at
        return out

    ahead = run(e, first, t)
    # backwards: the same over the reversed places; a place is cut off from the next one if that starts a chain
    ends = np.concatenate([first.ravel()[1:], [True]])
    behind = run(e[::-1, ::-1], ends[::-1].reshape(rows, width), t.T)[::-1, ::-1]
    p = ahead * behind / e  # the place's own emission is in both
    return (p[..., 1] / p.sum(-1)).ravel()[:n]


def _sample_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            got = list({f for w in set(tokens(text or b"")) for f in forms(w)})
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array([label] * len(got), pa.int32())], names=["form", "toxic"])


def lexicon(sample: DataFrame, tie: float = TIE) -> set[bytes]:
    """The forms tied to the label, all of them; the sample bounds their number. sample: text (binary), toxic."""
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return set()
    share = n[1] / (n[0] + n[1])
    by = sample.mapInArrow(_sample_forms, "form binary, toxic int").groupBy("form").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    by = by.where("t > 0").withColumn("r", F.col("t") / (F.col("t") + F.col("c"))).where(F.col("r") > max(0.5, share))
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    by = by.withColumn("g", part(F.col("t"), F.col("r"), F.lit(share)) + part(F.col("c"), 1 - F.col("r"), F.lit(1 - share))).where(F.col("g") >= tie)
    return set(by.select("form").toArrow().column("form").to_pylist())


def _windows(known: set[bytes]):
    """Training windows of a document: around some of its labelled words, by the hash of their places, and at even steps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                w = tokens(text or b"")
                hit = [k for k, x in enumerate(w) if label and not known.isdisjoint(forms(x))]
                chosen = sorted(hit, key=lambda k: zlib.crc32(b"%d" % k))[:WINDOWS]
                at = sorted({max(0, k - WINDOW // 2) for k in [*chosen, *(len(w) * j // WINDOWS for j in range(WINDOWS))]})
                got, marked = [w[a : a + WINDOW] for a in at if w[a : a + WINDOW]], set(hit)
                if got:
                    y = [[int(a + k in marked) for k in range(len(g))] for a, g in zip([a for a in at if w[a : a + WINDOW]], got, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.binary())), pa.array(y, pa.list_(pa.int32()))], names=["w", "y"])

    return cut


def train_field(windows: list[list[bytes]], labels: list[list[int]], steps: int = 80, rate: float = 0.15) -> dict[str, np.ndarray]:
    """Weights by cell, bias and transitions that maximise the windows' likelihood (less a quadratic penalty). Expectations are
    summed over PART windows at a time, so that memory doesn't follow their number."""
    seen: dict[bytes, int] = {}
    size = np.array(list(map(len, windows)))
    ids = np.fromiter((seen.setdefault(x, len(seen)) for w in windows for x in w), np.int32, size.sum())
    by_word = np.array([cells(x) for x in seen], np.int32)
    y = np.fromiter((v for w in labels for v in w), np.int8, size.sum())
    first = np.cumsum(size) - size
    inner = np.ones(len(ids), bool)
    inner[first] = False
    weight, bias, trans = np.zeros(CELLS), np.array([-2.0]), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, bias, trans)]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    for step in range(1, steps + 1):
        by_id = weight[by_word].sum(1) + bias[0]
        gap, pair = np.zeros(len(seen)), np.zeros((2, 2))
        for k in range(0, len(size), PART):
            some, a = size[k : k + PART], first[k]
            b = a + some.sum()
            p, expected = expectations(by_id[ids[a:b]], some, trans)
            gap += np.bincount(ids[a:b], y[a:b] - p, len(seen))
            pair += expected
        grads = (np.bincount(by_word.ravel(), np.repeat(gap, by_word.shape[1]), CELLS), np.array([gap.sum()]), seen_pairs - pair)
        for w, g, m, scale in zip((weight, bias, trans), grads, state, (1e-4, 0.0, 1e-3), strict=True):
            g = g / len(windows) - scale * w
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            w += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return {"weight": weight, "bias": bias, "trans": trans}


def expectations(odds: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals of state 1 of many short chains laid end to end, and the expected counts of (state, next state); all chains
    go through forward-backward at once, place by place."""
    first = np.cumsum(size) - size
    width = int(size.max())
    at = first[:, None] + np.arange(width)
    live = np.arange(width) < size[:, None]
    o = np.where(live, odds[np.minimum(at, len(odds) - 1)], 0.0)
    e = np.exp(np.stack([np.minimum(0, -o), np.minimum(0, o)], -1))
    t = np.exp(trans - trans.max())
    f = np.empty((len(first), width, 2))
    f[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    for k in range(1, width):
        f[:, k] = f[:, k - 1] @ t * e[:, k]
        f[:, k] /= f[:, k].sum(-1, keepdims=True)
    b = np.ones((len(first), 2))
    out, p = np.zeros((2, 2)), np.empty((len(first), width))
    p[:, -1] = f[:, -1, 1]
    for k in range(width - 2, -1, -1):
        on = live[:, k + 1]
        after = b * e[:, k + 1]
        joint = f[:, k, :, None] * t * after[:, None, :]
        out += (joint / joint.sum((1, 2), keepdims=True))[on].sum(0)
        new = after @ t.T
        b = np.where(on[:, None], new / new.sum(-1, keepdims=True), 1.0)
        both = f[:, k] * b
        p[:, k] = both[:, 1] / both.sum(-1)
    return p[live], out


class Scorer:
    """The field on texts, with a bounded memory of words it has seen."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.known = model, {}

    def odds(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        if new:
            v = self.model["weight"][np.array([cells(w) for w in new])].sum(1) + self.model["bias"][0]
            self.known.update(zip(new, v.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """By text, the marginals of its words."""
        split = [tokens(t) for t in texts]
        sizes = list(map(len, split))
        every = [w for s in split for w in s]
        starts = np.zeros(len(every), bool)
        starts[[a for a, n in zip(np.cumsum([0, *sizes])[:-1], sizes, strict=True) if n]] = True
        return np.split(forward_backward(self.odds(every), starts, self.model["trans"]), np.cumsum(sizes)[:-1])

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """By text: log odds that any word is toxic, log of 1 + the expected number of toxic words."""
        return self.measures_of(self.marginals(texts))

    @staticmethod
    def measures_of(marginals: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(marginals), 2))
        for k, p in enumerate(marginals):
            p = p[p >= LEAST]
            none = np.log1p(-np.clip(p, 0, 1 - 1e-12)).sum()
            out[k] = np.clip(np.log(max(-np.expm1(none), 1e-12)) - none, -12, 12), np.log1p(p.sum())
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.model.get("ready", True):
            return np.zeros(len(texts))
        return self._score(self.measures(texts))

    def _score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(measures @ self.model["slope"] + self.model["level"][0])))

    def scores_and_spans(self, texts: list[bytes], sure: float) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and each text's offending spans in characters."""
        if not self.model.get("ready", True):
            return np.zeros(len(texts)), [[] for _ in texts]
        marginals = self.marginals(texts)
        found = [in_characters(t, byte_spans(t, p, sure)) if (p >= sure).any() else [] for t, p in zip(texts, marginals, strict=True)]
        return self._score(self.measures_of(marginals)), found


def byte_spans(text: bytes, p: np.ndarray, sure: float) -> list[tuple[int, int]]:
    """Start and end, in bytes, of each run of words whose marginal is `sure` or more."""
    found, at = [], 0
    for w, x in zip(text.split(), p, strict=True):
        a = text.index(w, at)
        if x >= sure:
            if found and not text[found[-1][1] : a].strip():
                found[-1] = (found[-1][0], a + len(w))
            else:
                found.append((a, a + len(w)))
        at = a + len(w)
    return found


def in_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same spans counted in code points."""
    if text.isascii():
        return spans
    out, at, n = [], 0, 0
    for a, b in spans:
        n += len(text[at:a].decode("utf-8", "replace"))
        m = len(text[a:b].decode("utf-8", "replace"))
        out.append((n, n + m))
        at, n = b, n + m
    return out


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: dict[int, int] = SAMPLE) -> dict[str, np.ndarray]:
    """The model: field and document score. docs: doc_id, text; labels: doc_id, toxic; where: which labels may be used."""
    ids = F.broadcast(bounded_sample(labels, "toxic", sample, where))
    some = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(ids, "doc_id")
    # one text for each id, however many rows have it: so the sample is bounded
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("text", "toxic")
    some = shared_table(some, "labelled")
    known = lexicon(some)
    if not known:
        return {"ready": False}
    got = some.mapInArrow(_windows(known), "w array<binary>, y array<int>").toArrow()
    got = sorted(zip(got.column("w").to_pylist(), got.column("y").to_pylist(), strict=True))
    model = train_field([w for w, _ in got], [y for _, y in got])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            m = np.concatenate([s.measures(t) for t in by_bytes([t or b"" for t in b.column("text").to_pylist()], RUN)])
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1]), b.column("toxic")], names=["a", "b", "toxic"])

    rows = np.array(sorted(map(tuple, some.mapInArrow(measure, "a double, b double, toxic int").collect())))
    x, y = rows[:, :2], rows[:, 2]
    w = np.zeros(3)
    x1 = np.column_stack([x, np.ones(len(x))])
    for _ in range(25):  # Newton's steps, with a small penalty
        p = 1 / (1 + np.exp(-x1 @ w))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([0.1, 0.1, 1e-6])
        w += np.linalg.solve(h, x1.T @ (y - p) - np.array([0.1, 0.1, 0]) * w)
    return model | {"slope": w[:2], "level": w[2:]}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score(docs: DataFrame, model: dict[str, np.ndarray], sure: float = 0.5) -> DataFrame:
    """docs' columns but text, with score, predicted, and spans: (start, end) in characters of each run of offending words."""
    rest = others(docs, "text", "score", "predicted", "spans")
    kinds = dict(docs.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            p, found = [], []
            for t in by_bytes([t or b"" for t in b.column("text").to_pylist()], RUN):
                some, spans = s.scores_and_spans(t, sure)
                p += some.tolist()
                found += [[{"start": i, "end": j} for i, j in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(found, _SPANS)], names=[*rest, "score", "predicted", "spans"])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(add, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "score double, predicted int, spans array<struct<start:long,end:long>>"]))


def spans(docs: DataFrame, model: dict[str, np.ndarray], sure: float = 0.5) -> DataFrame:
    """docs' columns but text, with spans: (start, end) in bytes of each run of words whose marginal is `sure` or more."""
    rest = others(docs, "text", "spans")
    kinds = dict(docs.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            out = []
            for part in by_bytes([t or b"" for t in b.column("text").to_pylist()], RUN):
                if model.get("ready", True):
                    out += [[{"start": i, "end": j} for i, j in byte_spans(t, p, sure)] for t, p in zip(part, s.marginals(part), strict=True)]
                else:
                    out += [[] for _ in part]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, _SPANS)], names=[*rest, "spans"])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(add, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "spans array<struct<start:long,end:long>>"]))


def without_toxic(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs less those predicted toxic; text and the other columns as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            k = b.schema.get_field_index("text")
            p = [x for t in by_bytes([t or b"" for t in b.column(k).cast(pa.binary()).to_pylist()], RUN) for x in s.scores(t)]
            yield b.filter(pa.array([x < 0.5 for x in p], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""Personal data: patterns, and a skip-chain conditional random field that makes labels agree within a document.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. The field's nodes are the words that have
a digit or an @ (all others are outside any entity). Its potentials: features of a word's shape with its label; neighbouring
words' labels; and a skip potential between distant words of a document that are the same, or have the same digits, or are
e-mail-like and share their domain. Weights are learned by pseudo-likelihood from the patterns' own labels on a bounded
sample of documents. Marginals come from loopy sum-product message passing, a batch of documents at a time. Words whose
entity label has a marginal of `sure` or more, and that no pattern has found, are added as spans.

The sample is bounded by two parameters: `sample_docs` documents, by hash, and `sample_words` nodes of each, at even steps from
its start to its end (their neighbours are counted whether they are among these or not).

Cases: null and empty texts have no spans. Rows that repeat and null ids are treated alone, but a row that repeats is learned
from once. An empty table gives no rows.
Very long texts are read whole; a batch's texts are taken in runs of about two million characters. Other columns pass through
find() untouched, but those that have the names of its own columns give way.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import by_bytes, others

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = len(KINDS) + 1
#: Most documents that the field is fitted on, and most nodes of one of them.
SAMPLE_DOCS = 3000
SAMPLE_WORDS = 200
#: Cells of the features' weights.
CELLS = 4096
ROUNDS = 8
SURE = 0.9

# fixed values: the patterns of the base spans, e-mail's local part is looked up backwards from its @
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HIT = re.compile(r"[0-9@]")
#: Characters of texts that are labelled at once.
RUN = 2_000_000
NOT_DIGIT = re.compile(r"[^0-9]")
EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start and kind."""
    found = []
    if "@" in text:
        last = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def nodes(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the field's nodes, without the punctuation at the words' ends."""
    out = []
    for m in WORD.finditer(text):
        w = m.group()
        if not HIT.search(w):
            continue
        a, b = len(w) - len(w.lstrip(EDGE)), len(w.rstrip(EDGE))
        if a < b:
            out.append((m.start() + a, m.start() + b, w[a:b]))
    return out


def features(word: str, before: str, after: str) -> list[int]:
    """Cells of the word's features: its shape, its length, its digits, whether they pass Luhn, its neighbours."""
    digits = NOT_DIGIT.sub("", word)
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", word))[:24]
    fine = re.sub("[0-9]", "9", re.sub("[A-Za-z]+", "a", word))[:24]
    names = ["bias", "s" + shape, "f" + fine, f"n{min(len(digits), 20)}", f"l{len(digits) >= 12 and luhn(digits)}{len(digits) == len(word)}", f"@{'@' in word}{'.' in word}", "b" + before, "a" + after]
    return [zlib.crc32(x.encode()) % CELLS for x in names]


def _side(text: str, at: int, step: int) -> str:
    """What stands beside a word, roughly: an end of text, a digit, a sign, or a letter two places off."""
    k = at + 2 * step if step > 0 else at - 2
    c = text[k] if 0 <= k < len(text) else ""
    return "end" if not c else "9" if c.isdigit() else "a" if c.isalpha() else c


def graph(text: str) -> tuple[list[tuple[int, int, str]], list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Nodes, their features, chain edges (successive words) and skip edges (to the next alike one)."""
    found = nodes(text)
    feats = [features(w, _side(text, a, -1), _side(text, b - 1, 1)) for a, b, w in found]
    chain = [(k, k + 1) for k in range(len(found) - 1) if not text[found[k][1] : found[k + 1][0]].strip(EDGE).strip()]
    skip, last = [], {}
    for k, (_, _, w) in enumerate(found):
        digits = NOT_DIGIT.sub("", w)
        alike = {("w", w.lower())} | ({("d", digits)} if len(digits) >= 7 else set()) | ({("m", w.lower().rpartition("@")[2])} if "@" in w else set())
        for key in alike:
            if key in last and last[key] < k:
                skip.append((last[key], k))
            last[key] = k
    return found, feats, chain, sorted(set(skip))


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product. unary: (n, L) logs; edges: (m, 2) node numbers; pair: (m, L, L) logs of (first's, second's) labels."""
    n, width = unary.shape
    if not len(edges):
        z = np.exp(unary - unary.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), width))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + table
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    z = np.exp(belief - belief.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _sample_rows(text: str, most: int = SAMPLE_WORDS) -> list[dict]:
    """Training rows of a document: features, the base label, and the labels of those it shares potentials with."""
    found, feats, chain, skip = graph(text)
    label = [OUTSIDE] * len(found)
    starts = [a for a, _, _ in found]
    for start, kind, end in reversed(base_spans(text)):
        k = max(0, bisect.bisect_right(starts, start) - 1)
        while k < len(found) and starts[k] < end:
            if found[k][1] > start:
                label[k] = kind
            k += 1
    near: list[list[tuple[int, int]]] = [[] for _ in found]  # (role, label): 0 the one before, 1 the one after, 2 a skip
    for a, b in chain:
        near[a].append((1, label[b]))
        near[b].append((0, label[a]))
    for a, b in skip:
        near[a].append((2, label[b]))
        near[b].append((2, label[a]))
    chosen = range(len(found)) if len(found) <= most else [k * len(found) // most for k in range(most)]
    return [{"f": feats[k], "y": label[k], "near": [r * LABELS + x for r, x in near[k]]} for k in chosen]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, steps: int = 120, rate: float = 0.2) -> dict[str, np.ndarray]:
    """The field's weights, from the patterns' labels on at most sample_docs documents of sample_words nodes each. docs: doc_id, text."""
    h = F.xxhash64("doc_id", "text").alias("h")
    some = docs.where(F.col("text").rlike("[0-9@]")).select(h).distinct().orderBy("h").limit(sample_docs)
    # a row that repeats is one document here, so that it neither fills the sample nor makes it larger
    texts = docs.select(h, "text").join(F.broadcast(some), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).select("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for t in b.column("text").to_pylist() for r in _sample_rows(t or "", sample_words)]
            if got:
                yield pa.RecordBatch.from_pylist(got, pa.schema([("f", pa.list_(pa.int32())), ("y", pa.int32()), ("near", pa.list_(pa.int32()))]))

    got = texts.mapInArrow(rows, "f array<int>, y int, near array<int>").toArrow()
    unary, chain, same = np.zeros((CELLS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(2)
    if not got.num_rows:
        unary[:, OUTSIDE] = 1.0
        return {"unary": unary, "chain": chain, "same": same}
    flat = lambda name: got.column(name).combine_chunks()
    y = flat("y").to_numpy()
    f = flat("f").flatten().to_numpy().reshape(len(y), -1)
    # by node: how many neighbours of each role have each label
    near = np.zeros((len(y), 3 * LABELS))
    sizes = np.diff(flat("near").offsets.to_numpy())
    np.add.at(near, (np.repeat(np.arange(len(y)), sizes), flat("near").flatten().to_numpy()), 1)
    order = np.lexsort((*near.T, y, *f.T))  # the rows come in any order, sums of doubles shouldn't
    f, y, near = f[order], y[order], near[order]
    goal = np.eye(LABELS)[y]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (unary, chain, same)]
    for step in range(1, steps + 1):
        skip = near[:, 2 * LABELS :]
        s = unary[f].sum(1) + near[:, :LABELS] @ chain + near[:, LABELS : 2 * LABELS] @ chain.T + same[0] * skip
        p = np.exp(s - s.max(1, keepdims=True))
        gap = goal - p / p.sum(1, keepdims=True)
        grads = [np.stack([np.bincount(f.ravel(), np.repeat(gap[:, k], f.shape[1]), CELLS) for k in range(LABELS)], 1), near[:, :LABELS].T @ gap + gap.T @ near[:, LABELS : 2 * LABELS], np.array([(skip * gap).sum(), 0.0])]
        for w, g, m in zip((unary, chain, same), grads, state, strict=True):
            g = g / len(y) - 1e-4 * w
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            w += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    same[0] = max(same[0], 0.0)
    return {"unary": unary, "chain": chain, "same": same}


def label_batch(texts: list[str], model: dict[str, np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """The spans that the field finds in each text: (start, kind's number, end)."""
    unary, edges, pair, own, place = [], [], [], [], []
    together = model["same"][0] * np.eye(LABELS)
    for d, text in enumerate(texts):
        found, feats, chain, skip = graph(text)
        if not found:
            continue
        first = len(place)
        unary.append(model["unary"][np.array(feats)].sum(1))
        for some, table in ((chain, model["chain"]), (skip, together)):
            edges += [(a + first, b + first) for a, b in some]
            pair += [table] * len(some)
        own += [d] * len(found)
        place += [(a, b) for a, b, _ in found]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not place:
        return out
    p = marginals(np.concatenate(unary), np.array(edges, np.int64).reshape(-1, 2), np.array(pair).reshape(-1, LABELS, LABELS), rounds)
    best = p.argmax(1)
    for k in np.nonzero((best != OUTSIDE) & (p.max(1) >= sure))[0]:
        out[own[k]].append((place[k][0], int(best[k]), place[k][1]))
    return out


def all_spans(texts: list[str], model: dict[str, np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> list[tuple[list, list]]:
    """For each text: its base spans, and these with the field's spans that touch none of them."""
    out = []
    for text, more in zip(texts, label_batch(texts, model, rounds, sure), strict=True):
        base = base_spans(text)
        extra, k, reach = [], 0, 0
        for a, kind, b in sorted(more):  # base is by start; reach is how far the spans that start before b go
            while k < len(base) and base[k][0] < b:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= a:
                extra.append((a, kind, b))
        out.append((base, sorted(base + extra)))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: dict[str, np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """docs' columns but text, with n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans and n_added."""
    kinds = dict(docs.dtypes)
    fields = [*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]

    rest = others(docs, "text", *(n for n, _ in fields))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            parts = by_bytes(b.column("text").to_pylist(), RUN)
            for base, every in (x for p in parts for x in all_spans([t or "" for t in p], model, rounds, sure)):
                got.append((*(sum(x[1] == k for x in base) for k in range(len(KINDS))), hashlib.sha256(_text(base).encode()).hexdigest(), _text(every), len(every) - len(base)))
            cols = [pa.array([g[k] for g in got], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], names=[*rest, *(n for n, _ in fields)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"])
    return docs.mapInArrow(add, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of spans that overlap, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out.append(text[at:a] + f"<{KINDS[kind].upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: dict[str, np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """documents with personal data replaced in text (a null text stays null), n_chars to match."""
    kinds = dict(docs.dtypes)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for texts in by_bytes(b.column("text").to_pylist(), RUN):
                new += [t if t is None else redact(t, every) for t, (_, every) in zip(texts, all_spans([t or "" for t in texts], model, rounds, sure), strict=True)]
            k = b.schema.get_field_index("text")
            yield b.set_column(k, "text", pa.array(new, b.schema.field(k).type))

    return docs.mapInArrow(change, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)

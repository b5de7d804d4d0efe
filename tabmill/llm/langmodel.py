"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, beside a smoothed unigram base.

Words are counted over all training documents (partial counts in tasks, then a shuffle by word). The model's target classes are
the most frequent words and, for all others, `cells` groups by ending; a word of a group has its smoothed count's share of it,
each unseen word that of a count of 0. Contexts are finer: a word that is no class of its own has one of HASHED vectors, by its
hash. A class's score in a context is the product of its vector with the sum of the last `context` words' vectors, each scaled
by its place, plus a bias. Training: a bounded sample gives a common start; then documents are dealt by hash to shards of about
SHARD words, each shard trains on all its documents from there, in the hashes' order, with noise classes drawn from the counts
and shared by a batch, and the parameters are averaged by tokens. So the model doesn't depend on how the input is partitioned,
but for rounding. Scoring: matrix products give every context vector's scores of all classes by place, once a task; a context's
scores are their sums, normalised exactly.

The counts of the words that are most frequent in all documents, learned from or not, go to every task, a bounded table; a
document's other words are joined with the counts by word. None of these is frequent: one outside a table of HEAD words occurs
in no more than about one HEADth of all places.

Cases: a null or empty text is the end token alone. Rows that repeat are rows of their own. A null doc_id is in no held-out
fold. An empty table gives no rows. If nothing can be learned from (all rows held out), N and V are 0 and all words unknown.
Very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import row_hash, shared_table

#: Words that are target classes of their own, and groups of all others.
OWN, CELLS = 256, 64
#: Context vectors of all other words, by hash.
HASHED = 8192
#: Most words whose counts go to every task, the frequent ones.
HEAD = 100_000
CONTEXT, WIDTH = 4, 24
NOISE, BATCH = 64, 4096
#: Documents that the start is trained on, how often, and in what batches.
START_DOCS, START_PASSES, START_BATCH = 2000, 5, 1024
RATE = 0.1
#: Words that a shard of the training documents has on average.
SHARD = 1_000_000
#: The end token among the words; no word is empty.
END = b""
#: Most distinct words that a task counts before it hands them on.
PARTIAL = 300_000


def cell(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CELLS


def cell_of(word: Column) -> Column:
    """cell() of a column of words."""
    return (F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % CELLS).cast("int")


def hashed(word: bytes) -> int:
    return OWN + zlib.crc32(word) % HASHED


def chunks(texts: list[bytes | None], most: int = 2_000_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts as words with the end token, of about `most` bytes, with the first one's place."""
    first, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append([*(t or b"").lower().split(), END])
        size += len(t or b"")
        if size >= most:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def word_counts(docs: DataFrame) -> DataFrame:
    """word (in UTF-8; the end token is empty), cell, c (in rows to learn from), every (in all rows). docs: text (binary), learn."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("every", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for learn, some in enumerate(got):
                n = pa.array(list(some.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), n if learn else pa.array(np.zeros(len(some), np.int64)), n], schema=schema)
                some.clear()

        for b in batches:
            learn = b.column("learn").to_pylist()
            for first, part in chunks(b.column("text").to_pylist()):
                for k, w in enumerate(part, first):
                    got[learn[k]].update(w)
                if len(got[0]) + len(got[1]) > PARTIAL:
                    yield from out()
        yield from out()

    made = docs.select("text", F.col("learn").cast("int").alias("learn")).mapInArrow(count, "word binary, c long, every long")
    made = made.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))
    return made.select("word", cell_of(F.col("word")).alias("cell"), "c", "every")


class Words:
    """The counts' head and totals, as every task has them."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, cell_sum: np.ndarray, cell_words: np.ndarray):
        """head: words by falling count among those learned from (0: only in others)."""
        self.total, self.distinct = total, distinct
        self.place = {w: k for k, (w, _) in enumerate(head)}
        c = np.array([n for _, n in head], float)
        self.known = c > 0
        self.base = np.log10((c + 1) / (total + distinct + 1))
        self.room = cell_sum + cell_words + 1.0
        own = (np.arange(len(head)) < OWN) & self.known
        self.cls = np.array([k if own[k] else OWN + cell(w) for k, (w, _) in enumerate(head)], np.int32)
        self.ctx = np.array([k if own[k] else hashed(w) for k, (w, _) in enumerate(head)], np.int32)
        self.inside = np.where(own, 0.0, np.log10((c + 1) / self.room[np.maximum(self.cls - OWN, 0)])) if head else np.zeros(0)
        share = np.zeros(OWN + CELLS)
        share[: own.sum()] = c[own]
        share[OWN:] += self.room
        self.share = (share + 0.5) / (share + 0.5).sum()

    def classes(self, part: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts end to end: each word's place in the head (-1: none), its class, its context vector, and each text's length."""
        size = np.array([len(w) for w in part])
        every = [x for w in part for x in w]
        at = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        cls, ctx = (x[at] if len(x) else np.zeros(len(every), np.int32) for x in (self.cls, self.ctx))
        rare = np.nonzero(at < 0)[0]
        words = [every[k] for k in rare.tolist()]
        cls[rare] = OWN + np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64, len(words)) % CELLS
        ctx[rare] = OWN + np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % HASHED
        return at, cls, ctx, size


def contexts(ctx: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(words, CONTEXT): the context vectors before each word, nearest first; before a text's start stands OWN + HASHED."""
    n = len(ctx)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((n, CONTEXT), OWN + HASHED, np.int32)
    for k in range(1, CONTEXT + 1):
        if n > k:
            out[k:, k - 1] = np.where(place[k:] >= k, ctx[:-k], OWN + HASHED)
    return out


def fresh(share: np.ndarray) -> dict[str, np.ndarray]:
    """r: context vectors; place: scales by place; q: vectors of target classes, the last column their bias."""
    rng = np.random.default_rng(7)
    q = np.concatenate([rng.normal(0, 0.1, (OWN + CELLS, WIDTH)), np.log(share)[:, None]], 1)
    return {"r": rng.normal(0, 0.1, (OWN + HASHED + 1, WIDTH)).astype("f4"), "q": q.astype("f4"), "place": np.full((CONTEXT, WIDTH), 0.5, "f4")}


def train(model: dict[str, np.ndarray], square: dict[str, np.ndarray], target: np.ndarray, context: np.ndarray, share: np.ndarray, rng: np.random.Generator, batch: int = BATCH) -> None:
    """One pass of noise-contrastive estimation over the words, in place; square: the gradients' summed squares. Large arrays are
    made once and filled batch by batch."""
    log_noise = np.log(NOISE * share).astype("f4")
    edge = np.cumsum(share)
    r, q, place = model["r"], model["q"], model["place"]
    classes = np.arange(len(q))[:, None]
    batch = min(batch, max(1, len(target)))
    seen, spread = np.empty((CONTEXT * batch, WIDTH), "f4"), np.empty((CONTEXT * batch, WIDTH), "f4")
    guess, table = np.ones((batch, WIDTH + 1), "f4"), np.empty((batch, NOISE), "f4")
    for a in range(0, len(target), batch):
        y, h = target[a : a + batch], context[a : a + batch].T.ravel()
        n = len(y)
        noise = np.minimum(np.searchsorted(edge, rng.random(NOISE)), len(share) - 1)
        before = np.take(r, h, axis=0, out=seen[: len(h)], mode="clip").reshape(CONTEXT, n, WIDTH)
        np.einsum("ktd,kd->td", before, place, out=guess[:n, :WIDTH])
        g, wrong, qy, qn = guess[:n], table[:n], np.take(q, y, axis=0), q[noise]
        right = np.einsum("td,td->t", g, qy) - log_noise[y]
        np.matmul(g, qn.T, out=wrong)
        np.subtract(log_noise[noise], wrong, out=wrong)
        with np.errstate(over="ignore"):  # an overflow is a gradient of 0
            up = 1 / (1 + np.exp(right))
            np.exp(wrong, out=wrong)
        wrong += 1
        down = np.divide(-1, wrong, out=wrong)
        back = down @ qn[:, :WIDTH]
        back += up[:, None] * qy[:, :WIDTH]
        gq = (noise == classes).astype("f4") @ (down.T @ g)
        some, sums = _sums(y, up[:, None] * g)
        gq[some] += sums
        gp = np.einsum("ktd,td->kd", before, back)
        # a context vector's gradient is the sum of `back` over where it stands, by place; most don't occur in a batch
        parts = np.multiply(back[None], place[:, None], out=spread[: len(h)].reshape(CONTEXT, n, WIDTH)).reshape(-1, WIDTH)
        at, gr = _sums(h, parts)
        for name, on, grad in (("q", slice(None), gq), ("place", slice(None), gp), ("r", at, gr)):
            grad /= n
            total = square[name][on] + grad * grad
            square[name][on] = total
            model[name][on] += RATE * grad / np.sqrt(total + 1e-8)


def _sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in at, below 2^16, and the sum of the rows of each. Numbers of 16 bits are sorted by their digits."""
    short = at.astype(np.uint16)
    order = np.argsort(short, kind="stable")
    short = short[order]
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    return short[first], np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)


class Normalised:
    """A model ready to score. A class's exponential is the product of its bias' and of one for each place of the context, so
    these come from tables by matrix products, exponentiated once: tables[k][context vector, class]."""

    def __init__(self, model: dict[str, np.ndarray]):
        q, bias = model["q"][:, :-1], model["q"][:, -1].astype(float)
        self.bias = bias
        self.start = np.exp(bias - bias.max()).astype("f4")
        self.tables = [(model["r"] * p) @ q.T for p in model["place"]]
        # tables are exponentiated if no product of theirs can leave a float's range
        self.safe = sum(float(np.abs(x).max()) for x in self.tables) + float(np.ptp(bias)) < 80
        if self.safe:
            for x in self.tables:
                np.exp(x, out=x)

    def logs(self, target: np.ndarray, context: np.ndarray, rows: int = 512) -> np.ndarray:
        """Natural logs of the targets' normalised probabilities."""
        out = np.empty(len(target))
        whole, part = (np.empty((rows, len(self.bias)), "f4") for _ in range(2))
        join = np.multiply if self.safe else np.add
        for a in range(0, len(target), rows):
            y, h = target[a : a + rows], context[a : a + rows]
            n = len(y)
            s = np.take(self.tables[0], h[:, 0], axis=0, out=whole[:n], mode="clip")
            for k in range(1, len(self.tables)):
                join(s, np.take(self.tables[k], h[:, k], axis=0, out=part[:n], mode="clip"), out=s)
            own = s[np.arange(n), y].astype(float)
            if self.safe:
                out[a : a + rows] = np.log(own) + self.bias[y] - self.bias.max() - np.log(s @ self.start)
            else:
                s = s + self.bias
                top = s.max(1)
                out[a : a + rows] = own + self.bias[y] - top - np.log(np.exp(s - top[:, None]).sum(1))
        return out


def _rows(model: dict[str, np.ndarray], weight: int, schema: pa.Schema) -> pa.RecordBatch:
    """Parameters as rows: name and number, weight, values times weight."""
    keys = [f"{name}{k}" for name, v in model.items() for k in range(len(v))]
    values = np.concatenate([np.pad(v, ((0, 0), (0, WIDTH + 1 - v.shape[1]))) for v in model.values()]).astype(float) * weight
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), weight)), *(pa.array(np.ascontiguousarray(x)) for x in values.T)], schema=schema)


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words that are most frequent in all rows, by falling count in those learned from; at most `most`, as all words of a
    step of counts (a 16th of a doubling) are in or out. No sort and no merge of long lists: the steps' sizes decide the least
    count. None, if more than `most` words share the highest step: then each is rare."""
    step = F.floor(F.log2("every") * 16).cast("int")
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    inside = [s for (s, _), total in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if total <= most]
    if not inside:
        return []
    got = counts.where(step >= min(inside)).select("word", "c").toArrow()
    return sorted(zip(got.column("word").to_pylist(), got.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, learn: Column | None = None) -> tuple[dict[str, np.ndarray], Words, DataFrame]:
    """The model, the head of the counts, and all counts (word, cell, c, every). docs: text, and doc_id if copies of
    a text are to be dealt apart; rows of `learn`, or all, are learned from."""
    spark = docs.sparkSession
    deal = row_hash(*(F.col(c) for c in docs.columns if c in ("doc_id", "text"))).alias("deal")
    docs = docs.select(F.col("text").cast("binary").alias("text"), (F.lit(True) if learn is None else learn).alias("learn"), deal)
    counts = shared_table(word_counts(docs), "words")
    docs = docs.where("learn").select("text", "deal")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    head = frequent(counts, HEAD)
    tail = counts.where("c > 0").join(F.broadcast(spark.createDataFrame([(w,) for w, c in head[:OWN] if c], "word binary")), "word", "left_anti")
    cell_sum, cell_words = np.zeros(CELLS), np.zeros(CELLS)
    for r in tail.groupBy("cell").agg(F.sum("c").alias("s"), F.count("*").alias("k")).collect():
        cell_sum[r.cell], cell_words[r.cell] = r.s, r.k
    words = Words(head, n, v, cell_sum, cell_words)
    model = fresh(words.share)
    if not n:
        return model, words, counts
    sent = spark.sparkContext.broadcast(words)
    names = ["key", "weight", *(f"x{k}" for k in range(WIDTH + 1))]
    schema = pa.schema([("key", pa.string()), ("weight", pa.int64()), *((x, pa.float64()) for x in names[2:])])

    def trainer(start: dict[str, np.ndarray], passes: int, batch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, square, seen = {k: x.copy() for k, x in start.items()}, {k: np.full_like(x, 1e-5) for k, x in start.items()}, 0
            rng = np.random.default_rng(11)
            for b in batches:
                for _, part in chunks(b.column("text").to_pylist()):
                    _, cls, ctx, size = sent.value.classes(part)
                    h = contexts(ctx, size)
                    for _ in range(passes):
                        order = rng.permutation(len(cls))
                        train(own, square, cls[order], h[order], sent.value.share, rng, batch)
                    seen += len(cls)
            if seen:
                yield _rows(own, seen, schema)

        return run

    def averaged(df: DataFrame, start: dict[str, np.ndarray], passes: int, batch: int) -> dict[str, np.ndarray]:
        got = df.mapInArrow(trainer(start, passes, batch), ", ".join(f"{f.name} {'string' if f.name == 'key' else 'long' if f.name == 'weight' else 'double'}" for f in schema))
        got = got.groupBy("key").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()
        mean = np.stack([got.column(x).to_numpy() for x in names[2:]], 1) / got.column("weight").to_numpy()[:, None]
        row = {k: i for i, k in enumerate(got.column("key").to_pylist())}
        return {k: mean[[row[f"{k}{i}"] for i in range(len(x))], : x.shape[1]].astype("f4") for k, x in start.items()}

    h = F.xxhash64("text")
    some = docs.select(h.alias("h")).distinct().orderBy("h").limit(START_DOCS)
    few = docs.join(F.broadcast(some), h == F.col("h"), "left_semi").dropDuplicates(["text"])
    model = averaged(few.coalesce(1).sortWithinPartitions("text"), model, START_PASSES, START_BATCH)
    dealt = docs.repartition(-(-n // SHARD), "deal").sortWithinPartitions("deal")
    return averaged(dealt, model, 1, BATCH), words, counts


def score(docs: DataFrame, model: dict[str, np.ndarray], words: Words, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs (doc_id, text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, words))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("rows", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = sent.value
        ready = Normalised(model)
        for b in batches:
            for first, part in chunks(b.column("text").to_pylist()):
                at, cls, ctx, size = words.classes(part)
                logs = ready.logs(cls, contexts(ctx, size)) / np.log(10)
                seen = at >= 0
                known = seen & words.known[at] if len(words.known) else seen
                base = np.where(seen, words.base[at], 0.0) if len(words.base) else np.zeros(len(at))
                logs += np.where(seen, words.inside[at], 0.0) if len(words.base) else 0.0
                start = np.cumsum(size) - size
                sums = [np.add.reduceat(x, start) for x in (known.astype("i8"), base, logs)]
                absent = np.nonzero(~seen)[0]
                edge = np.searchsorted(absent, np.append(start, len(at)))
                rest, times, many = [None] * len(part), [0] * len(part), np.zeros(len(part), np.int64)
                for k in np.nonzero(np.diff(edge))[0].tolist():
                    w = part[k]
                    got = Counter(w[j] for j in (absent[edge[k] : edge[k + 1]] - start[k]).tolist())
                    rest += got
                    times += got.values()
                    many[k] = len(got)
                who = np.arange(first, first + len(part))
                who, fill = pa.array(np.concatenate([who, np.repeat(who, many)])), len(rest) - len(part)
                cols = [np.ones(len(part), np.int64), size, *sums]
                cols = [pa.array(np.concatenate([c, np.zeros(fill, c.dtype)])) for c in cols]
                cols = [b.column("doc_id").take(who), b.column("h").take(who), *cols, pa.array(rest, pa.binary()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    d = d.mapInArrow(run, "doc_id long, h long, rows long, n long, known long, base double, score double, word binary, times long")
    tail = counts.select(F.col("word").alias("_word"), F.col("c").alias("_c"))
    d = d.join(tail, F.col("word") == F.col("_word"), "left")
    c = F.coalesce("_c", F.lit(0))
    room = F.get(F.array(*(F.lit(float(x)) for x in words.room)), cell_of(F.col("word")))
    other = F.col("word").isNotNull()
    d = d.select(
        "doc_id", "h", "rows", "n",
        (F.col("known") + F.when(other & (c > 0), F.col("times")).otherwise(0)).alias("known"),
        (F.col("base") + F.when(other, F.col("times") * F.log10((c + 1) / F.lit(float(words.total + words.distinct + 1)))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(other, F.col("times") * F.log10((c + 1) / room)).otherwise(0.0)).alias("score"),
    )
    # rows that repeat share doc_id and h: their sums are divided again and each gets its row back
    d = d.groupBy("doc_id", "h").agg(*(F.sum(x).alias(x) for x in ("rows", "n", "known", "base", "score")))
    d = d.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_k"))
    each = lambda x: F.expr(f"{x} div rows")
    return d.select("doc_id", each("n").alias("n_tokens"), each("known").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))


def fit_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """score() of all docs, learned from those that aren't held out; with held_out. docs: doc_id, text."""
    model, words, counts = fit(docs, ~held_out)
    return score(docs, model, words, counts).withColumn("held_out", held_out)

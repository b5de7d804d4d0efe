"""Packing documents into token sequences, to target proportions of sources.

Documents are encoded once, into a written table, and dealt into groups of about GROUP tokens. What a group holds of each source
is fixed to the token: were all tokens dealt at the target proportions, a source that is used up leaving its part to the others,
then a group is what is dealt from its first token to its last. So each source's documents, in an order by hash, are cut into
one run a group, documents included; the cells (by hash) that a cut goes through are sent to both groups, which cut them there.
In a group each source has a queue. Deficit round-robin fills one window after another: a source's deficit grows by its share of
the window, as many of its tokens are taken as the deficit allows, and what isn't taken is carried on; from group to group, what
is carried is the fraction of a token that the cut left. All tokens are packed, each once. Sources without a weight come when
those with one are used up, by their tokens. A window is WINDOW sequences of `length` tokens; documents are cut where a source's
turn, a group or a sequence ends. What is left at a group's end fills sequences whose lengths are powers of two, so nothing is
padded.

Cases: a null or empty text is the end token alone. A null source is a source of its own. Null ids are packed like any other.
Repeated rows are told apart by a number within their task, and so are dealt over all groups. An empty table gives no rows.
Very long texts are encoded whole, and cut between groups like others. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm import tokens
from tabmill.llm.mixing import running_total
from tabmill.llm.text import shared_table

LENGTH = 2048
#: Sequences in a window.
WINDOW = 16
#: Tokens in a group, about.
GROUP = 4_000_000
#: Cells that a group's documents are in, by hash.
CELLS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def encoded(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, source (of text, never null), h (of id and text), copy (rows of this h before it in its task), n (with the end token),
    ids (compressed 16-bit numbers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("copy", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, seen = zstandard.ZstdCompressor(1), Counter()
        for b in batches:
            n, ids, copy = [], [], []
            for h, t in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                copy.append(seen[h])
                seen[h] += 1
                got = tokens.encode(t.as_py(), vocabulary)
                got.append(tokens.END)
                n.append(len(got))
                ids.append(press.compress(np.array(got, "<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("h"), pa.array(copy, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return d.mapInArrow(run, "doc_id long, source string, h long, copy long, n long, ids binary")


def deal(queues: dict[str, deque], share: dict[str, float], owed: dict[str, float], window: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, length) in packing order. queues: by source, [document, start, tokens left]; emptied here."""
    left = {s: sum(q[2] for q in x) for s, x in queues.items()}
    debt = {s: owed.get(s, 0.0) for s in queues}
    order = sorted(queues)
    while total := sum(left.values()):
        room, take = min(window, total), dict.fromkeys(order, 0)
        # sources with a share first; the others, by their tokens, have what these leave
        for tier in ([s for s in order if share[s] > 0], [s for s in order if share[s] <= 0]):
            rest = fresh = min(room, sum(left[s] for s in tier))
            room -= rest
            while fresh >= 1 and (live := [s for s in tier if take[s] < left[s]]):
                weight = {s: share[s] if share[s] > 0 else left[s] for s in live}
                whole = sum(weight.values())
                for s in live:
                    debt[s] += fresh * weight[s] / whole
                    k = min(left[s] - take[s], max(0, int(debt[s])), rest)
                    take[s], debt[s], rest = take[s] + k, debt[s] - k, rest - k
                # what an empty queue is still owed goes to the others
                empty = [s for s in live if take[s] == left[s] and debt[s] > 0]
                fresh = sum(debt[s] for s in empty)
                debt |= dict.fromkeys(empty, 0.0)
            # rounding: the window is filled exactly, a token each from those that are owed most
            while rest:
                for s in sorted((s for s in tier if take[s] < left[s]), key=lambda s: (-debt[s], s))[:rest]:
                    take[s], debt[s], rest = take[s] + 1, debt[s] - 1, rest - 1
        for s in order:
            k = take[s]
            left[s] -= k
            while k:
                doc, start, n = queues[s][0]
                m = min(n, k)
                yield doc, start, m
                k -= m
                if m == n:
                    queues[s].popleft()
                else:
                    queues[s][0] = [doc, start + m, n - m]


def lengths(total: int, length: int) -> list[int]:
    """The sequences' lengths: full ones, then falling powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Schedule:
    """How many tokens of a source the first groups hold, if all are dealt at target proportions.

    sizes: tokens by source with a weight; total: of all sources. While sources with a weight are left, each has been dealt its
    weight times a common level (or all it has); the levels at which one is used up are the corners.
    """

    def __init__(self, total: int, groups: int, weights: dict[str, float] | None = None, sizes: dict[str, int] | None = None):
        self.total, self.groups = total, groups
        self.weights = None if weights is None else {s: w for s, w in weights.items() if w > 0 and sizes.get(s)}
        self.corners, level, dealt = [(0.0, 0.0)], 0.0, 0.0
        left = dict(sorted((self.weights or {}).items(), key=lambda x: sizes[x[0]] / x[1]))
        self.named = sum(sizes[s] for s in left)
        whole = sum(left.values())
        for s, w in list(left.items()):
            top = sizes[s] / w
            dealt += (top - level) * whole
            level, whole = top, max(0.0, whole - w)
            self.corners.append((dealt, level))

    def at(self, group: int) -> int:
        """The first token of a group, among all."""
        return self.total * group // self.groups

    def level(self, group: int) -> float:
        """The common level when a group starts."""
        t = self.at(group)
        for (t0, v0), (t1, v1) in zip(self.corners, self.corners[1:], strict=False):
            if t < t1:
                return v0 + (v1 - v0) * (t - t0) / (t1 - t0)
        return float("inf")

    def dealt(self, source: str, size: int, group: int) -> tuple[int, float]:
        """Tokens of a source before a group, and what it has been dealt beyond them."""
        if group >= self.groups:
            return size, 0.0
        if self.weights is None:
            return size * group // self.groups, size * group % self.groups / self.groups
        if source in self.weights:
            exact = min(float(size), self.weights[source] * self.level(group))
            return (size, 0.0) if exact >= size else (int(exact), exact - int(exact))
        rest, own = self.total - self.named, max(0, self.at(group) - self.named)
        return size * own // max(rest, 1), 0.0

    def share(self, source: str, size: int) -> float:
        return size / max(self.total, 1) if self.weights is None else self.weights.get(source, 0.0)

    def group_of(self, source: str, size: int, token: int) -> int:
        """The group that holds a source's token."""
        lo, hi = 0, self.groups - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.dealt(source, size, mid)[0] <= token else (lo, mid - 1)
        return lo


def pack_group(docs: pa.Table, plan: Schedule, length: int = LENGTH, window: int = WINDOW) -> pa.Table:
    """One group's pieces. docs: the documents of all cells that reach into it, with `before`, the tokens of their source in front
    of their cell, and `all`, those of their source."""
    import zstandard

    docs = docs.sort_by([("before", "ascending"), ("cell", "ascending"), ("h", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("copy", "ascending")])
    source, n, ids, cell, before, size = (docs.column(c).to_pylist() for c in ("source", "n", "ids", "cell", "before", "all"))
    group = docs.column("grp")[0].as_py()
    queues: dict[str, deque] = {}
    share, owed, bounds, place = {}, {}, {}, {}
    for k, s in enumerate(source):
        if s not in bounds:
            (lo, more), (hi, _) = plan.dealt(s, size[k], group), plan.dealt(s, size[k], group + 1)
            bounds[s], owed[s], share[s] = (lo, hi), more, plan.share(s, size[k])
        at = place.get((s, cell[k]), before[k])
        place[s, cell[k]] = at + n[k]
        first, last = max(at, bounds[s][0]), min(at + n[k], bounds[s][1])
        if first < last:
            queues.setdefault(s, deque()).append([k, first - at, last - first])
    sizes = lengths(sum(q[2] for x in queues.values() for q in x), length)
    undo, out, seq, offset, opened = zstandard.ZstdDecompressor(), [], 0, 0, {}
    for doc, start, m in deal(queues, share, owed, length * window):
        if doc not in opened:
            opened[doc] = np.frombuffer(undo.decompress(ids[doc], max_output_size=2 * n[doc]), "<u2").astype("<u4")
        while m:
            k = min(m, sizes[seq] - offset)
            out.append((doc, start, k, zlib.crc32(opened[doc][start : start + k].tobytes()), n[doc], (group << 32) + seq, offset, sizes[seq]))
            start, m, offset = start + k, m - k, offset + k
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0
        if start == n[doc]:
            del opened[doc]
    own = docs.column("doc_id").take(pa.array([o[0] for o in out], pa.int64())).combine_chunks()
    return pa.Table.from_arrays([own, *(pa.array([o[k] for o in out], pa.int64()) for k in range(1, 8))], schema=_PIECES)


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, length: int = LENGTH, window: int = WINDOW, group: int = GROUP, weights: dict[str | None, float] | None = None) -> DataFrame:
    """A row per piece (see PIECES). docs: doc_id, text, source. weights: the sources' target proportions; by default their tokens'."""
    d = shared_table(encoded(docs, vocabulary), "encoded")
    total = d.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group))
    d = d.withColumn("cell", F.pmod(F.when(F.col("copy") > 0, F.xxhash64("h", "copy")).otherwise(F.col("h")), F.lit(groups * CELLS)))
    cells = d.groupBy("source", "cell").agg(F.sum("n").alias("n"))
    whole = cells.groupBy("source").agg(F.sum("n").alias("all"))
    named = None if weights is None else {"" if s is None else "=" + s: float(w) for s, w in weights.items()}
    # only the sizes of sources that the caller named reach the driver
    sizes = None if named is None else {r.source: r["all"] for r in whole.where(F.col("source").isin(*named)).collect()}
    plan = Schedule(total, groups, named, sizes)
    cells = running_total(cells, ["source"], ["cell"], "n", "before", F.floor(F.col("cell") / 1024)).join(whole, "source").select("source", "cell", "n", "before", "all")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [(plan.group_of(s, a, at), plan.group_of(s, a, at + n - 1)) for s, n, at, a in zip(*(b.column(c).to_pylist() for c in ("source", "n", "before", "all")), strict=True)]
            rows = pa.array([k for k, (lo, hi) in enumerate(spans) for _ in range(lo, hi + 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("source", "cell", "before", "all")), pa.array([g for lo, hi in spans for g in range(lo, hi + 1)], pa.int64())], names=["source", "cell", "before", "all", "grp"])

    cells = shared_table(cells.mapInArrow(reached, "source string, cell long, before long, all long, grp long"), "cells")
    # broadcast or not, as Spark decides by the written table's size
    d = d.join(cells, ["source", "cell"])
    return d.groupBy("grp").applyInArrow(lambda t: pack_group(t, plan, length, window), PIECES)

"""SimHash near-duplicates: fingerprints, and a self-join of binary tries under a Hamming budget.

Documents with one fingerprint are one class from the start, so copies cost nothing further. The 64 bits are cut into five
blocks; two fingerprints that differ in three bits at most agree in two whole blocks, whichever. For each of the ten choices
of two blocks there is one trie per value of those blocks, over the other 38 bits. Such a trie is joined with itself from its
root: a pair of nodes carries how many bits differ between their paths, and goes on to the pairs of their children unless that
exceeds the budget; at single fingerprints the bits that are left decide. While a node has more than `leaf` fingerprints, Spark
goes down (eight levels at a time, a table of node pairs a step); the sub-tries below are traversed to their leaves inside a
task. There a pair of nodes whose fingerprints are all connected already isn't entered, so that only a spanning forest of the
links comes out, which loses no connection, and dense groups don't give all their pairs. Classes are then united by components
of the links.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any other. Fewer than three words make one shingle
of all. Rows that repeat are in one class. A null doc_id gets its component's smallest id, or null if there is none. An
empty table gives no rows. Other columns are ignored by near_duplicates(), but those named fp, component_id or root give way;
first_of_each() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm.graph import components
from tabmill.llm.text import others, row_hash, shared_table

BUDGET = 3
#: Words in a shingle here; the contract of this operator names three.
SHINGLE = 3
SEED = 42
#: Most fingerprints of a sub-trie that one task traverses to its leaves.
LEAF = 64
#: Levels of the trie that one step of Spark goes down.
STEP = 8
BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text in UTF-8, as a signed number."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else list(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), CHUNK):
        part = grams[at : at + CHUNK]
        h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs' columns but text, and fp."""
    rest = others(docs, "text", "fp", "component_id", "root")
    kinds = dict(docs.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), fp], names=[*rest, "fp"])

    return docs.select(*rest, F.col("text").cast("binary").alias("text")).mapInArrow(add, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", fp long")


def _signed(bits: list[int]) -> int:
    return int(np.array(sum(1 << x for x in bits), np.uint64).view(np.int64))


def _orders() -> list[tuple[list[int], list[int]]]:
    """For each choice of two blocks: the bits of these, which make up a trie's root, and the other bits, by level."""
    ends = np.cumsum(BLOCKS)
    bits = [list(range(e - n, e)) for e, n in zip(ends.tolist(), BLOCKS, strict=True)]
    return [(bits[a] + bits[b], [x for i, block in enumerate(bits) if i not in (a, b) for x in block]) for a, b in combinations(range(len(BLOCKS)), 2)]


def _masks(step: int) -> list[list[int]]:
    """For each choice of two blocks: the bits that make up a node's path, at each depth, as signed numbers."""
    return [[_signed(root + rest[: d * step]) for d in range(-(-len(rest) // step) + 1)] for root, rest in _orders()]


class Traversal:
    """The join of sub-tries: pairs of nodes from the top, differing bits summed, down to single fingerprints."""

    def __init__(self, levels: list[int], budget: int):
        """levels: the bits that the sub-tries' levels are about, from the top."""
        self.levels, self.budget = levels, budget
        self.below = [sum(1 << x for x in levels[k:]) for k in range(len(levels) + 1)]
        self.links: list[tuple[int, int]] = []
        self.entered = 0  # pairs of nodes that were looked at
        self.root: dict[int, int] = {}

    def _top(self, k: int) -> int:
        while self.root.get(k, k) != k:
            k = self.root[k]
        return k

    def _split(self, node: list[int], level: int) -> tuple[list[int], list[int]]:
        bit = self.levels[level]
        return [x for x in node if not x >> bit & 1], [x for x in node if x >> bit & 1]

    def alone(self, node: list[int], level: int = 0) -> None:
        """A node with itself: each child with itself, and the two with each other."""
        while len(node) > 1 and level < len(self.levels):
            self.entered += 1
            zero, one = self._split(node, level)
            level += 1
            if zero and one:
                self.alone(zero, level)
                self.alone(one, level)
                self.pair(zero, one, level, 1)
                return
            node = zero or one

    def pair(self, a: list[int], b: list[int], level: int, bits: int) -> None:
        """Two nodes of one level whose paths differ in `bits` bits."""
        self.entered += 1
        if bits > self.budget or not a or not b:
            return
        if len(a) == 1 and len(b) == 1:
            p, q = self._top(a[0]), self._top(b[0])
            if p != q and bits + ((a[0] ^ b[0]) & self.below[level]).bit_count() <= self.budget:
                self.root[p] = q
                self.links.append((a[0], b[0]))
            return
        if len({self._top(x) for x in a} | {self._top(x) for x in b}) == 1 or level == len(self.levels):
            return
        (a0, a1), (b0, b1) = self._split(a, level), self._split(b, level)
        self.pair(a0, b0, level + 1, bits)
        self.pair(a1, b1, level + 1, bits)
        self.pair(a0, b1, level + 1, bits + 1)
        self.pair(a1, b0, level + 1, bits + 1)


def links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """x, y: pairs of distinct fingerprints that connect what is within the budget. prints: fp, distinct."""
    if budget > len(BLOCKS) - 2:
        raise ValueError(f"a budget of {len(BLOCKS) - 2} bits at most; two of {len(BLOCKS)} blocks must agree")
    masks, rest = _masks(step), [r for _, r in _orders()]

    def forest(depth: int):
        """A spanning forest of the links between two nodes' fingerprints (or inside one node), by traversal from these nodes down."""

        @F.pandas_udf("array<struct<x:long,y:long>>")
        def run(t: pd.Series, a: pd.Series, b: pd.Series, bits: pd.Series, same: pd.Series) -> pd.Series:
            out = []
            for trie, i, j, n, s in zip(t, a, b, bits, same, strict=True):
                walk = Traversal(rest[trie][depth * step :], budget)
                i, j = (np.asarray(x, np.int64).view(np.uint64).tolist() for x in (i, j))
                if s:
                    walk.alone(i)
                else:
                    walk.pair(i, j, 0, int(n))
                back = np.array(walk.links, np.uint64).reshape(-1, 2).view(np.int64).tolist()
                out.append([{"x": p, "y": q} for p, q in back])
            return pd.Series(out)

        return run

    def path(depth: int):
        return F.get(F.array(*(F.lit(m[depth]) for m in masks)), F.col("t"))

    rows = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m[0])).alias("node")) for t, m in enumerate(masks)))).alias("r")).select("fp", "r.*")
    sizes = rows.groupBy("t", "node").agg(F.count("*").alias("n")).where("n > 1")
    # most fingerprints are alone in their tries and stay behind here
    rows = shared_table(rows.join(sizes, ["t", "node"]), "tries")
    found = []
    depth, pairs = 0, None
    while True:
        small = rows.where(F.col("n") <= leaf)
        buckets = small.groupBy("t", "node").agg(F.collect_list("fp").alias("fps"))
        if pairs is None:
            found.append(buckets.select(F.explode(forest(0)("t", "fps", "fps", F.lit(0), F.lit(True))).alias("e")))
            pairs = rows.where(F.col("n") > leaf).select("t", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("bits")).distinct()
            active = rows
        else:
            # pairs whose two nodes are buckets are compared; the others go down
            active = rows
            size_a = active.select("t", F.col("node").alias("a"), F.col("n").alias("na")).distinct()
            size_b = active.select("t", F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
            pairs = shared_table(pairs.join(size_a, ["t", "a"]).join(size_b, ["t", "b"]), "pairs")
            both = pairs.where((F.col("na") <= leaf) & (F.col("nb") <= leaf))
            both = both.join(buckets.select("t", F.col("node").alias("a"), F.col("fps").alias("fa")), ["t", "a"]).join(buckets.select("t", F.col("node").alias("b"), F.col("fps").alias("fb")), ["t", "b"])
            found.append(both.select(F.explode(forest(depth)("t", "fa", "fb", "bits", F.col("a") == F.col("b"))).alias("e")))
            pairs = pairs.where((F.col("na") > leaf) | (F.col("nb") > leaf)).select("t", "a", "b", "bits")
        depth += 1
        if depth == len(masks[0]) or pairs.isEmpty():
            break
        # one step down: a node's children are the longer paths of its fingerprints
        ends = pairs.select("t", F.explode(F.array("a", "b")).alias("node")).distinct()
        below = active.join(ends, ["t", "node"], "left_semi").select("t", "fp", F.col("node").alias("parent"), F.col("fp").bitwiseAND(path(depth)).alias("node"))
        count = below.groupBy("t", "parent", "node").agg(F.count("*").alias("n"))
        kids_a = count.select("t", F.col("parent").alias("a"), F.col("node").alias("ka"))
        kids_b = count.select("t", F.col("parent").alias("b"), F.col("node").alias("kb"))
        pairs = pairs.join(kids_a, ["t", "a"]).join(kids_b, ["t", "b"])
        # paths of equal length differ in all the bits that the two nodes' paths differ in
        pairs = pairs.select("t", F.col("ka").alias("a"), F.col("kb").alias("b"), F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))).alias("bits"), (F.col("a") == F.col("b")).alias("twin"))
        pairs = shared_table(pairs.where((F.col("bits") <= budget) & (~F.col("twin") | (F.col("a") <= F.col("b")))).drop("twin"), "pairs")
        rows = shared_table(below.join(count.select("t", "node", "n"), ["t", "node"]).select("t", "node", "fp", "n"), "tries")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("e.x", "e.y")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED, leaf: int = LEAF) -> DataFrame:
    """docs' columns but text, and fp, component_id (the smallest doc_id of all that links reach)."""
    prints = shared_table(fingerprints(docs, shingle, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = components(links(classes.select("fp"), budget, leaf)).select(F.col("v").alias("fp"), "root")
    classes = classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id", "root")
    return prints.join(classes, "fp")


def first_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """documents with one row of each component: its smallest doc_id (null last); of rows that share it, one by their hashes."""
    row = row_hash(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
    own = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("_doc"), F.col("doc_id"), F.coalesce("doc_id", F.lit(-1)).alias("_id"), row.alias("_row"), "text")
    found = near_duplicates(own.select("doc_id", "_id", "_row", "text"), budget)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_id", "_row")).alias("k")).select("k._id", "k._row")
    return own.join(keep, ["_id", "_row"]).dropDuplicates(["_id", "_row"]).select("_doc.*")

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tabmill.llm import simhash
from tabmill.llm.queries import op6_simhash_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def groups(prints):
    """Components under 3 differing bits, by trying all pairs."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def partition(keys, items):
    out = {}
    for k, x in zip(keys, items, strict=True):
        out.setdefault(k, set()).add(x)
    return sorted(sorted(x) for x in out.values() if len(x) > 1)


@pytest.mark.parametrize("leaf", [2, 64])
def test_links_keep_every_component(spark, leaf):
    rng = np.random.default_rng(leaf)
    prints = set()
    for _ in range(6):
        seed = int(rng.integers(0, 2**63))
        for _ in range(60):  # chains of near fingerprints around a few centres
            for b in rng.integers(0, 64, 2):
                seed ^= 1 << int(b) if rng.random() < 0.8 else 0
            prints.add(seed)
    prints = sorted({x if x < 2**63 else x - 2**64 for x in prints} | {0, -1, 7})
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), leaf=leaf).collect()
    unsigned = [x % 2**64 for x in prints]
    assert all(((r.x ^ r.y) % 2**64).bit_count() <= 3 for r in found)
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[top(r.x)] = top(r.y)
    assert partition(map(top, prints), prints) == partition(groups(unsigned), prints)


def test_query_is_right(spark, sf):
    rows = op6_simhash_groups(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    prints = [plain_fingerprint(text[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    least = {}
    for k, r in zip(groups(prints), rows, strict=True):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[k] for k in groups(prints)]


def test_traversal_of_documents_tries(spark):
    """The tries of the documents' fingerprints are gone down pair by pair; what comes out connects what all pairs connect."""
    prints = sorted({plain_fingerprint(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()})
    found, entered, nodes = [], 0, 0
    for root, rest in simhash._orders():
        tries = {}
        for x in prints:
            tries.setdefault(sum(x & 1 << b for b in root), []).append(x)
        for node in (v for v in tries.values() if len(v) > 1):
            walk = simhash.Traversal(rest, 3)
            walk.alone(node)
            found, entered, nodes = found + walk.links, entered + walk.entered, nodes + 1
    assert nodes > 10 and entered > 2 * nodes
    near = {(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    assert all((max(p), min(p)) in near for p in found)
    assert partition(component(prints, found), prints) == partition(groups(prints), prints)


def component(prints, pairs):
    root = {x: x for x in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    return [top(x) for x in prints]


def test_traversal_prunes_and_spares_pairs():
    rng = np.random.default_rng(8)
    order = list(range(64))
    far = [int(x) for x in rng.integers(0, 2**63, 2000)]
    walk = simhash.Traversal(order, 3)
    walk.alone(far)
    assert not walk.links and walk.entered < 2000 * 1999 // 4  # pairs of nodes over the budget aren't gone into
    ball = sorted({7 ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (600, 2))})
    walk = simhash.Traversal(order, 4)
    walk.alone(ball)
    assert len(walk.links) == len(ball) - 1 and walk.entered < len(ball) ** 2 // 4  # a spanning tree, not all pairs


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (4, "One two", None, "a", 7), (5, "one  TWO", "en", "b", 8), (6, "a b c " * 30_000, None, None, 180_000), (None, "one two", None, "a", 7), (4, "One two", None, "a", 7)]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 fp", "2 root", "3 node")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(d.select("doc_id", "text", "node", "fp", "root")).collect())
    assert got == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    more = simhash.first_of_each(spark.createDataFrame(rows, DOCS).selectExpr("*", "7 _row", "8 _id", "9 fp"))
    assert more.columns[-3:] == ["_row", "_id", "fp"] and sorted((r.doc_id, r._row, r._id, r.fp) for r in more.collect()) == [(k, 7, 8, 9) for k in (1, 4, 6)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS).select("doc_id", "text")).count() == 0

"""Nearest neighbours by cosine, along shifted space-filling curves.

Each curve takes the vectors, made unit length, through its own random projection to a few coordinates, spreads and shifts
these, and numbers the cell they fall in along a Hilbert curve. Spark range-partitions the rows by that number (then by id, so
that equal vectors don't make one partition large) and gives each its place along the curve. A curve's places are cut into
blocks; a query is compared with its own block and some on both sides, and what the curves find for a query is merged and ranked.

How many curves are followed, and how many blocks on both sides, is measured: of a bounded sample of queries (SAMPLE, by hash)
the true neighbours are found among all rows, in one pass, and the cheapest numbers are taken with which the windows hold
TARGET of these. At least two curves are followed. Vectors in clusters need few blocks, whatever their number; of vectors at
random in many dimensions nearly all rows must be looked at, and are. The projections are drawn, not fitted.

`exact` adds a check after the windows: each query's k-th best cosine is a bound, the first curve's order is cut into cells with
a centre and a reach, and a query is compared with the cells that could still hold something nearer. On vectors without any
structure few cells can be ruled out; on clustered ones most are.

Each comparison ranks in single precision first, and scores whatever lies within the error of that of the k-th best in double
precision, on the original vectors, before it cuts to k. So near copies, however many, can't push each other out. Of identical
vectors in a block those with the k + 1 smallest ids are compared, since no other can be among a query's k nearest.

Cases: rows with a null id, a null, empty, zero or non-finite vector (or null components) take no part. Vectors of different
lengths are never compared; each length is searched by itself. Rows that share an id are rows of their own: each is a candidate
for the others, and each is a query if its id is one. Ties go to the smaller id. With fewer than k candidates a query gets all.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tabmill.llm.text import shared_table
from tabmill.operators.ranking import global_rank

K = 5
CURVES = 6
#: Coordinates and bits of each along a curve; their product is at most 62.
COORDS, BITS = 3, 12
#: Least and most rows of a block of a curve, and about how many blocks there are between.
LEAST, MOST, BLOCKS = 512, 8192, 64
#: Queries whose true neighbours are found to measure windows by, and what share of these the windows must hold.
SAMPLE, TARGET = 256, 0.97
CELL = 256
#: Rows in a block of the exact check, and queries that are held against it at once.
BLOCK, QUERIES = 16_384, 8192
#: Pairs that are scored in double precision at once.
PAIRS = 262_144


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of points with coordinates in 0 .. 2^bits - 1, (rows, coordinates); Skilling's transform."""
    x = x.T.astype(np.int64).copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = m
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Places of unit vectors along a curve."""
    dim = unit.shape[1]
    rng = np.random.default_rng([curve, dim])
    z = unit @ rng.normal(0, 1, (dim, COORDS))  # about standard normal for directions at random
    spread = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution function
    shift = rng.random(COORDS) if curve else np.zeros(COORDS)
    return hilbert(np.minimum(((spread + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """uid (a number of the row), id, v (array of doubles): the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    d = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return d.where(F.coalesce(fine, F.lit(False)))


def _matrix(b: pa.RecordBatch | pa.Table, kind: str, dim: int) -> np.ndarray:
    """Column u, the bytes of original vectors, as doubles scaled by powers of two: scores don't change, and stay finite."""
    v = np.frombuffer(b"".join(b.column("u").to_pylist()), kind).reshape(b.num_rows, dim).astype(float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, added from the first column to the last, as SQL does."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def doubt(dim: int) -> float:
    """No single-precision cosine of rounded unit vectors is further off than this, in whatever order it is summed."""
    return (dim + 8) * 2.0**-23


def _least_ids(ids: np.ndarray, uids: np.ndarray, v: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` rows of smallest ids of each group of identical vectors."""
    if len(ids) <= keep:
        return np.arange(len(ids))
    rows = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()  # -0.0 is 0.0
    group = np.unique(rows, return_inverse=True)[1]
    order = np.lexsort((uids, ids, group))
    start = np.concatenate([[True], np.diff(group[order]) != 0])
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))
    return np.sort(order[place < keep])


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])
FOUND = "query long, query_id long, uid long, id long, near double"


def _compare(query: np.ndarray, qid: np.ndarray, q: np.ndarray, uid: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest of these rows (q, x: scaled doubles; query, uid: rows' numbers), but those surely below its `least`."""
    if not len(query):
        return
    on = _least_ids(ids, uid, x, k + 1)
    uid, ids, x = uid[on], ids[on], x[on]
    order, off = np.argsort(uid), doubt(x.shape[1])
    unit, norm = _unit(x).astype("<f4"), np.sqrt(_dot(x, x))
    for a in range(0, len(query), 256):
        some, qs = query[a : a + 256], q[a : a + 256]
        s = _unit(qs).astype("<f4") @ unit.T
        at = order[np.minimum(np.searchsorted(uid, some, sorter=order), len(uid) - 1)]
        own = np.nonzero(uid[at] == some)[0]
        s[own, at[own]] = -np.inf
        bound = np.full(len(some), -3.0) if least is None else least[a : a + 256] - off
        if len(ids) > k:
            bound = np.maximum(bound, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k].astype(float) - 2 * off)
        i, j = np.nonzero(s >= np.maximum(bound, -3.0)[:, None])
        score, length = np.empty(len(i)), np.sqrt(_dot(qs, qs))
        for p in range(0, len(i), PAIRS):
            u, w = i[p : p + PAIRS], j[p : p + PAIRS]
            score[p : p + PAIRS] = _dot(qs[u], x[w]) / (length[u] * norm[w])
        best = np.lexsort((uid[j], ids[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        yield pa.RecordBatch.from_arrays([pa.array(some[i], pa.int64()), pa.array(qid[a : a + 256][i], pa.int64()), pa.array(uid[j], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(score[first])], schema=_FOUND)


def stored(d: DataFrame, kind: str) -> DataFrame:
    """dim, uid, id, u (the vector's bytes, of this numpy kind) of usable(). Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(sizes)
            u = pa.array([flat[z - n : z].tobytes() for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32)), b.column("uid"), b.column("id"), u], names=["dim", "uid", "id", "u"])

    return shared_table(d.select("uid", "id", "v").mapInArrow(run, "dim int, uid long, id long, u binary"), "vectors")


def _by_length(b: pa.RecordBatch, kind: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = b.filter(pa.array(dims == dim))
        yield dim, some, _matrix(some, kind, dim)


def along_curves(vectors: DataFrame, curves: int, kind: str) -> DataFrame:
    """dim, curve, uid, id, place: every row's place along each curve of its length. Written; without the vectors, so that what is
    sorted is thin. vectors: stored()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, some, v in _by_length(b, kind):
                unit = _unit(v)
                for c in range(curves):
                    whole = [pa.array(np.full(some.num_rows, x, np.int32)) for x in (dim, c)]
                    yield pa.RecordBatch.from_arrays([*whole, pa.array(curve_keys(unit, c)), some.column("uid"), some.column("id")], names=["dim", "curve", "key", "uid", "id"])

    rows = vectors.mapInArrow(run, "dim int, curve int, key long, uid long, id long")
    ranked = global_rank(rows, ["dim", "curve", "key", "id", "uid"], "place")
    first = ranked.groupBy("dim", "curve").agg(F.min("place").alias("_first"))  # a row for each length and curve
    return shared_table(ranked.join(first, ["dim", "curve"]).withColumn("place", F.col("place") - F.col("_first")).drop("_first", "key"), "curves")


def true_neighbours(vectors: DataFrame, is_query: Column, k: int, kind: str, sample: int) -> DataFrame:
    """FOUND of at most `sample` queries, chosen by hash, against all rows: one pass, the sample in every task."""
    some = vectors.where(is_query).orderBy(F.xxhash64(F.lit(5), "uid"), "uid").limit(sample).toArrow()
    by = {dim: (t.column("uid").to_numpy(), t.column("id").to_numpy(), m) for dim, t, m in (x for b in some.combine_chunks().to_batches() for x in _by_length(b, kind))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, x in _by_length(b, kind):
                if dim in by:
                    query, qid, q = by[dim]
                    for a in range(0, len(x), MOST):
                        part = slice(a, a + MOST)
                        yield from _compare(query, qid, q, rows.column("uid").to_numpy()[part], rows.column("id").to_numpy()[part], x[part], k)

    return merged(vectors.mapInArrow(run, FOUND), k)


def windows(placed: DataFrame, truth: DataFrame, size: int, curves: int, target: float, blocks: int) -> tuple[int, int]:
    """How many curves to follow and how many blocks to look at on each side, so that `target` of the true neighbours are seen at
    the least cost. Only the sample's places reach the driver."""
    pairs = truth.select("query", "uid").collect()
    if not pairs:
        return min(2, curves), 0
    spark = placed.sparkSession
    uids = spark.createDataFrame([(u,) for u in sorted({x for p in pairs for x in (p.query, p.uid)})], "uid long")
    at = {(r.uid, r.curve): r.place // size for r in placed.join(F.broadcast(uids), "uid").select("uid", "curve", "place").collect()}
    apart = np.array([[abs(at[p.query, c] - at[p.uid, c]) for c in range(curves)] for p in pairs])
    choices = []
    for n in range(min(2, curves), curves + 1):
        least = np.sort(apart[:, :n].min(1))
        reach = int(least[min(len(least) - 1, int(np.ceil(target * len(least))) - 1)])
        choices.append((n * min(2 * reach + 1, blocks), n, reach))
    return min(choices)[1:]


def merged(found: DataFrame, k: int) -> DataFrame:
    """FOUND with rank: each query's k best, one row per candidate."""
    every = found.groupBy("query", "uid").agg(F.first("query_id").alias("query_id"), F.first("id").alias("id"), F.max("near").alias("near"))
    rank = Window.partitionBy("query").orderBy(F.desc("near"), "id", "uid")
    return every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, window: int | None = None, exact: bool = True, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows. is_query: a condition on `id`. window: rows of windows
    along all curves, instead of measured ones."""
    kind = "<f4" if vectors.select("embedding").schema[0].dataType == ArrayType(FloatType()) else "<f8"
    own = stored(usable(vectors), kind)
    placed = along_curves(own, curves, kind)
    n, n_queries = own.agg(F.count("*"), F.count_if(is_query)).first()
    if window is None:
        size = min(MOST, max(LEAST, -(-n // BLOCKS)))
        curves, reach = windows(placed, true_neighbours(own, is_query, k, kind, SAMPLE), size, curves, target, -(-n // size))
    else:
        size, reach = max(1, window // 2), 1
    # a block's rows meet the queries that see it in sets of a bounded size
    sets = max(1, -(-min(n_queries, n_queries * (2 * reach + 1) * size // max(n, 1)) // (8 * QUERIES)))
    vector = own.select("uid", "u")
    rows = placed.where(F.col("curve") < curves).withColumn("block", F.floor(F.col("place") / size)).drop("place").join(vector, "uid")
    every = F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    last = placed.groupBy("dim").agg(F.floor(F.max("place") / size).alias("_last"))  # a row for each length
    beside = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.col("_last")))).alias("block")
    queries = rows.where(is_query).join(last, "dim").select("dim", "curve", beside, F.pmod(F.xxhash64("uid"), F.lit(sets)).cast("int").alias("set"), "uid", "id", "u")
    queries = queries.toDF(*queries.columns)  # columns of their own: both sides come from one table
    rows = rows.withColumn("set", every) if sets > 1 else rows.withColumn("set", F.lit(0))
    keys = ["dim", "curve", "block", "set"]

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _FOUND.empty_table()
        dim = a.column("dim")[0].as_py()
        x, q = _matrix(a, kind, dim), _matrix(b, kind, dim)
        return pa.Table.from_batches(_compare(b.column("uid").to_numpy(), b.column("id").to_numpy(), q, a.column("uid").to_numpy(), a.column("id").to_numpy(), x, k), _FOUND)

    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(near, FOUND)
    if exact:
        found = shared_table(merged(found, k), "windows")
        found = found.drop("rank").unionByName(checked(placed.where("curve = 0").join(vector, "uid"), is_query, found, k, kind))
    return merged(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("near").alias("score"))


def checked(placed: DataFrame, is_query: Column, found: DataFrame, k: int, kind: str) -> DataFrame:
    """FOUND of what could still be nearer than a query's k-th best so far: queries held against blocks of all rows."""
    cells = placed.select("dim", "place", "uid", "id", "u", F.floor(F.col("place") / BLOCK).cast("int").alias("block"))
    bound = found.where(F.col("rank") == k).select(F.col("query").alias("uid"), F.col("near").alias("least"))
    queries = cells.where(is_query).select("dim", "uid", "id", "u").join(bound, "uid", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    sets = max(1, -(-queries.count() // QUERIES))
    blocks = cells.groupBy("dim").agg(F.max("block").alias("_most"))
    queries = queries.join(blocks, "dim").select("dim", "uid", "id", "u", "least", F.pmod(F.xxhash64("uid"), F.lit(sets)).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("block"))
    queries = queries.toDF(*queries.columns)
    held = cells.select("dim", "place", "uid", "id", "u", "block", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))

    def check(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _FOUND.empty_table()
        a, dim = a.sort_by([("place", "ascending")]), a.column("dim")[0].as_py()
        uid, ids, x = a.column("uid").to_numpy(), a.column("id").to_numpy(), _matrix(a, kind, dim)
        query, qid, q, least = b.column("uid").to_numpy(), b.column("id").to_numpy(), _matrix(b, kind, dim), b.column("least").to_numpy()
        out: list[pa.RecordBatch] = []
        at = list(range(0, len(ids), CELL))
        unit, to = _unit(x), _unit(q)  # in doubles: the angle of a small cosine error is large where vectors are close
        centre = np.stack([unit[c : c + CELL].mean(0) for c in at])
        size = np.linalg.norm(centre, axis=1)
        centre /= np.maximum(size, 1e-9)[:, None]
        reach = np.array([np.arccos(np.clip((unit[p : p + CELL] @ c).min(), -1, 1)) if s > 1e-9 else np.pi for p, c, s in zip(at, centre, size, strict=True)])
        angle = np.arccos(np.clip(to @ centre.T, -1, 1))
        could = np.cos(np.maximum(0, angle - reach)) >= least[:, None] - 1e-5
        for p in range(0, len(qid), 256):  # queries that need the same cells are compared with these at once
            some = slice(p, p + 256)
            cell = np.nonzero(could[some].any(0))[0]
            if len(cell):
                on = np.concatenate([np.arange(at[c], min(at[c] + CELL, len(ids))) for c in cell])
                out += _compare(query[some], qid[some], q[some], uid[on], ids[on], x[on], k, least[some])
        return pa.Table.from_batches(out, _FOUND)

    return held.groupBy("dim", "block", "set").cogroup(queries.groupBy("dim", "block", "set")).applyInArrow(check, FOUND)

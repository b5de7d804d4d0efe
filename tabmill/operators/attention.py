"""In-context scoring: context rows answer for query rows. Collections of tables by group, one large table by broadcast.

A query row's answer depends on itself and its table's context alone, so query rows may be dealt in any way. attend() streams
the context past sets of query rows and merges softmax states, so neither side is bounded; score_collection() takes this way for
tables whose context is too large for a task, if the scorer is attention. There a narrow table with many query rows isn't compared
pair by pair: sums over the cells of a grid stand for the context's rows (summed()), so that work grows with the rows, not with
their pairs. For other scorers the context of one table is held by
its tasks; its size is checked against max_context first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmill.functions import kernel
from tabmill.sources.storage import written

#: Most context rows of a table that is scored by broadcast.
MAX_CONTEXT = 10_000
#: Context rows of a block, and query rows of a set, that one task compares.
PIECE = 4096
#: Most query rows of a table that one task of a collection scores; a larger table's are dealt over several.
SLICE = 8192
#: Query rows of a set, which a task holds while a table's context passes.
SETS = 32_768
#: Most context and query rows of a table that goes through a model together with others, and how many go together.
SMALL, TOGETHER = 256, 8
#: Rows of whole tables that a task gathers before it scores them.
GATHERED = 16_384
#: Numbers of a product that attend() holds: about what a core's cache does.
TILE = 1 << 18
#: Most features of a table whose context is summed by cells, and the degree of the sums.
NARROW, DEGREE = 4, 16
#: Query rows of a table's level, and context rows of the table, from which sums are made.
WORTH = 2048
#: Least rows of a cell that is summed.
FULL = 128
#: Cells that are compared with query rows at once, and rows whose products of powers are held at once.
CELLS, ROWS = 256, 256
#: Numbers of a product of query and context rows that are held at once.
PRODUCT = 1 << 22
Score = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long arrays; missing numbers are NaN."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)


@dataclass(frozen=True)
class Attention:
    """Context rows vote with their labels (class shares), or with their targets if n_classes is None."""

    n_classes: int | None

    def __call__(self, cx: np.ndarray, cy: np.ndarray, qx: np.ndarray) -> np.ndarray:
        if not len(cx):
            return np.full((len(qx), self.n_classes or 1), np.nan)
        mean, std = kernel.context_scale(cx)
        z = lambda v: np.clip((v - mean) / (std + kernel.EPSILON), -100, 100)
        values = cy[:, None] if self.n_classes is None else np.eye(self.n_classes)[cy.astype(int)]
        context, step = z(cx), max(1, PRODUCT // len(cx))
        parts = [kernel.weighted_labels(context, values, z(qx[k : k + step])) for k in range(0, len(qx), step)]
        return np.concatenate(parts) if parts else np.zeros((0, values.shape[1]))


def attention_scorer(n_classes: int | None) -> Score:
    return Attention(n_classes)


@dataclass(frozen=True)
class Model:
    """The full forward pass: logits."""

    weights: dict[str, np.ndarray]

    def __call__(self, cx: np.ndarray, cy: np.ndarray, qx: np.ndarray) -> np.ndarray:
        if not len(cx) or not len(qx):
            return np.full((len(qx), int(self.weights["architecture"][4])), np.nan)
        model, step = kernel.Forward(self.weights, cx, cy), max(1, PRODUCT // (len(cx) * (cx.shape[1] + 1)))
        return np.concatenate([model.score(qx[k : k + step]) for k in range(0, len(qx), step)])

    def many(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """What each table gets alone; small ones of one width go together, in the order of their sizes, so that little is padded."""
        out: list[np.ndarray | None] = [None] * len(tables)
        small = [k for k, (cx, _, qx) in enumerate(tables) if 0 < len(cx) <= SMALL and 0 < len(qx) <= SMALL]
        for k in set(range(len(tables))) - set(small):
            out[k] = self(*tables[k])
        small.sort(key=lambda k: (tables[k][0].shape[1], len(tables[k][0]), len(tables[k][2])))
        while small:
            own = [k for k in small[:TOGETHER] if tables[k][0].shape[1] == tables[small[0]][0].shape[1]]
            for k, got in zip(own, kernel.Forward.many(self.weights, [tables[k] for k in own]), strict=True):
                out[k] = got
            small = small[len(own) :]
        return out


def model_scorer(weights: dict[str, np.ndarray]) -> Score:
    return Model(weights)


def score_collection(rows: DataFrame, score: Score, most: int = SLICE, max_context: int = MAX_CONTEXT) -> DataFrame:
    """dataset_id, row_idx, y, output: query rows of many tables. rows: dataset_id, row_idx, x, y, is_context.

    A table is one group; one with more than `most` query rows is as many groups as they need, each with all its context. A table
    with more than max_context context rows is answered by attend(), if the scorer is attention; for others it is an error.
    """
    thin = rows.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("row_idx").cast("long").alias("row_idx"), "x", F.col("y").cast("double").alias("y"), "is_context")
    sizes = thin.groupBy("dataset_id").agg(F.count_if("is_context").alias("c"), F.count_if(~F.col("is_context")).alias("q"))
    # only tables past a bound are listed: each has that many rows, so they are few beside the rows
    large = [(r["dataset_id"], r["c"] > max_context, -(-r["q"] // most)) for r in sizes.where((F.col("c") > max_context) | (F.col("q") > most)).collect()]
    beyond = [k for k, wide, _ in large if wide]
    if not beyond:
        return _score_groups(thin, score, [(k, n) for k, _, n in large])
    if not isinstance(score, Attention):
        raise ValueError(f"more than {max_context} context rows in tables {beyond[:10]}")
    named = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in beyond], "dataset_id long"))
    wide = thin.join(named, "dataset_id", "left_semi").withColumnsRenamed({"dataset_id": "table", "row_idx": "row_id"})
    out = attend(store_context(wide.where("is_context"), score.n_classes), wide.where("not is_context"))
    out = wide.where("not is_context").select("table", "row_id", "y").join(out, ["table", "row_id"]).select(F.col("table").alias("dataset_id"), F.col("row_id").alias("row_idx"), "y", "output")
    return _score_groups(thin.join(named, "dataset_id", "left_anti"), score, [(k, n) for k, w, n in large if not w]).unionByName(out)


def _score_groups(thin: DataFrame, score: Score, sliced: list[tuple[int, int]]) -> DataFrame:
    """score_collection() of tables whose context a task can hold. sliced: tables with more than a task's query rows, and in how
    many groups they go."""
    if sliced:
        large = F.broadcast(thin.sparkSession.createDataFrame(sliced, "_id long, _slices int"))
        slices = F.coalesce("_slices", F.lit(1))
        own = F.when(F.col("is_context"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("row_idx"), slices).cast("int")))
        thin = thin.join(large, F.col("dataset_id") == F.col("_id"), "left").select("dataset_id", F.explode(own).alias("_slice"), "row_idx", "x", "y", "is_context")
    else:
        thin = thin.select("dataset_id", F.lit(0).alias("_slice"), "row_idx", "x", "y", "is_context")

    def told(tables: list[tuple]) -> pa.RecordBatch:
        """The answers of whole tables, each a key and its parts."""
        ids, rows, targets, asked = [], [], [], []
        for (name, _), parts in tables:
            x, y, row, on = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in range(4))
            at = np.flatnonzero(on)
            at = at[np.argsort(row[at], kind="stable")]
            if not on.all():
                asked.append((x[at], y[at], x[~on]))
                ids += [name] * len(asked[-1][2])
                rows.append(row[~on])
                targets.append(y[~on])
        out = score.many(asked) if isinstance(score, Model) else [score(*t) for t in asked]
        sizes = np.concatenate([[0], *(np.full(len(o), o.shape[1]) for o in out)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0), *(o.ravel() for o in out)])))
        numbers = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), numbers(rows, np.int64), numbers(targets, float), flat], names=["dataset_id", "row_idx", "y", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [], 0  # the last of them may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            ids, place = b.column("dataset_id"), b.column("_slice").to_numpy()
            known, name = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            ends = np.flatnonzero((name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (known[1:] != known[:-1])) + 1
            y, row = b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("row_idx").to_numpy(zero_copy_only=False)
            on = b.column("is_context").fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi in zip([0, *ends], [*ends, b.num_rows], strict=True):
                key = (int(name[lo]) if known[lo] else None, int(place[lo]))
                if not tables or tables[-1][0] != key:
                    if n >= GATHERED:
                        yield told(tables)
                        tables, n = [], 0
                    tables.append((key, []))
                tables[-1][1].append((matrix(b.column("x").slice(lo, hi - lo)), y[lo:hi], row[lo:hi], on[lo:hi]))
                n += hi - lo
        if tables:
            yield told(tables)

    return thin.repartition("dataset_id", "_slice").sortWithinPartitions("dataset_id", "_slice").mapInArrow(run, "dataset_id long, row_idx long, y double, output array<double>")


def collect_context(context: DataFrame, max_context: int = MAX_CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """x, y of a table's context, in a fixed order; an error if it is larger than may be sent to every task."""
    got = context.select("row_id", "x", F.col("y").cast("double").alias("y")).orderBy("row_id").limit(max_context + 1).collect()
    if len(got) > max_context:
        raise ValueError(f"more than {max_context} context rows")
    return np.array([r.x for r in got], float).reshape(len(got), -1), np.array([r.y for r in got], float)


def score_table(queries: DataFrame, cx: np.ndarray, cy: np.ndarray, score: Score) -> DataFrame:
    """queries with `output`. Works on batches and on streams; x is a column of queries."""
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = score(cx, cy, matrix(b.column("x"))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*b.schema.names, "output"])

    return queries.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in queries.columns), "output array<double>"]))


@dataclass(frozen=True)
class StoredContext:
    """Scaled context rows of tables of any size, written, with each table's facts. See attend()."""

    rows: DataFrame
    facts: DataFrame
    n_values: int
    classes: bool


def store_context(context: DataFrame, n_classes: int | None) -> StoredContext:
    """context: table, row_id, x, y, where y is a class (0, 1, ...) or, if n_classes is None, a target. Written once: features
    are scaled by their table's mean and deviation, and clipped, as attention_scorer() does."""
    context = written(context.select("table", "row_id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")), "context")
    cells = context.select("table", F.posexplode("x").alias("k", "v")).withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    scale = cells.groupBy("table", "k").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).groupBy("table").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "std"))).alias("scale"))
    facts = written(context.groupBy("table").agg(F.count("*").alias("n_context")).join(scale, "table"), "facts")
    return StoredContext(written(_scaled(context, facts), "scaled"), facts, n_classes or 1, n_classes is not None)


def _scaled(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with x scaled by its table's facts; a missing number is NaN."""
    d = rows.join(facts.select(F.col("table").alias("_t"), "scale"), F.col("table") == F.col("_t")).drop("_t")
    z = lambda x, s: F.greatest(F.least((x - s["mean"]) / (s["std"] + kernel.EPSILON), F.lit(100.0)), F.lit(-100.0))
    nan = F.lit(float("nan"))
    return d.withColumn("x", F.zip_with("x", "scale", lambda x, s: F.when(F.isnan(x) | x.isNull() | s["std"].isNull() | F.isnan(s["std"]), nan).otherwise(z(x, s)))).drop("scale")


def _level(x: Column) -> Column:
    """The least k >= 0 for which the absolute values of x sum up to 2 ** k or less; 0 if they have no sum."""
    size = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    return F.when(~F.isnan(size) & (size > 1), F.ceil(F.log2(size))).otherwise(0).cast("int")


def _runs(b: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows one after the other that agree in these columns."""
    if not b.num_rows:
        return
    new = np.zeros(b.num_rows, bool)
    for c in map(b.column, names):
        if pa.types.is_list(c.type):  # of numbers, of up to NARROW
            n = pc.list_value_length(c).to_numpy(zero_copy_only=False)
            v = np.full((len(c), n.max()), np.inf)
            v[np.arange(n.max()) < n[:, None]] = c.flatten().to_numpy(zero_copy_only=False)
            new[1:] |= (v[1:] != v[:-1]).any(1)
        else:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    starts = [0, *np.flatnonzero(new).tolist()]
    for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
        yield tuple(b.column(c)[a].as_py() for c in names), b.slice(a, z - a)


def summed(stored: StoredContext, levels: DataFrame) -> DataFrame:
    """table, level, row_id, x, y, w: the stored context for query rows of these levels (table, level), of tables of up to NARROW
    features.

    Of a query row q of level k the absolute values sum up to 2 ** k at most. The context is cut into cells by a grid whose half
    step is sqrt(width) / 2 ** k: then q . (c - m) / sqrt(width) is at most 1 for each row c of a cell with the centre m, and its
    exponential is, to the rounding of doubles, a polynomial of degree DEGREE. So a cell's share in a softmax is exp(q . m /
    sqrt(width)) times a product of q's powers and sums of powers over the cell's rows. Rows of a cell with few of them stay as
    they are (w is null); others are one row: x its centre, w the sums, by value and term. A cell has at least a sixteenth as many
    rows as w has numbers, so w takes no more than about 128 bytes a context row and level. Rows with missing numbers stay.
    """
    parts = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, classes = stored.n_values, stored.classes
    full = F.get(F.array(*(F.lit(max(FULL, math.comb(d + DEGREE, d) * (width + 1) // 16)) for d in range(NARROW + 1))), F.size("x"))
    half = F.sqrt(F.size("x")) / F.pow(F.lit(2.0), F.col("level"))
    centre = F.when(~F.exists("x", F.isnan), F.transform("x", lambda v: (2 * F.floor(v / (2 * half)) + 1) * half))
    rows = stored.rows.join(levels, "table").withColumn("centre", centre)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("table", "row_id")}
    cells = rows.groupBy("table", "level", "centre", full.alias("full")).agg(F.count("*").alias("n")).where("n >= full and centre is not null")
    cells = cells.select(*(F.col(c).alias(f"_{c}") for c in ("table", "level", "centre")), "n")
    rows = rows.join(cells, (F.col("table") == F.col("_table")) & (F.col("level") == F.col("_level")) & (F.col("centre") == F.col("_centre")), "left")
    names = ["table", "level", "centre"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(batches, [*names, "slice"], of_rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(batches, names, lambda key, b: matrix(b.column("w")).sum(0))

    def of_rows(key: tuple, b: pa.RecordBatch) -> np.ndarray:
        y = b.column("y").to_numpy(zero_copy_only=False)
        values = np.column_stack([np.eye(width)[y.astype(int)] if classes else y, np.ones(len(y))])
        v = (matrix(b.column("x")) - key[2]) / (np.sqrt(len(key[2])) / 2.0 ** key[1])
        factors, out = kernel.inverse_factorials(v.shape[1], DEGREE), 0
        for k in range(0, len(v), ROWS):
            out = out + kernel.monomials(v[k : k + ROWS], DEGREE) @ values[k : k + ROWS]
        return (out * factors).T.ravel()

    def added(batches: Iterator[pa.RecordBatch], by: list[str], made: Callable[[tuple, pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """What is made of each run, added up while the key stays."""
        now, at, total = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(at.column(c) for c in names), pa.array([total], pa.list_(pa.float64()))], names=[*names, "w"])

        for b in batches:
            for key, own in _runs(b, by):
                if key != now:
                    if now is not None:
                        yield told()
                    now, at, total = key, own.slice(0, 1), 0
                total = total + made(key, own)
        if now is not None:
            yield told()

    schema = f"table {kind['table']}, level int, centre array<double>, w array<double>"
    dense = rows.where("n is not null").select(*names, F.pmod(F.xxhash64("row_id", "x"), F.ceil(F.col("n") / SLICE)).alias("slice"), "x", "y")
    dense = dense.repartition(parts, *names, "slice").sortWithinPartitions(*names, "slice").mapInArrow(sums, schema)
    dense = dense.repartition(parts, *names).sortWithinPartitions(*names).mapInArrow(whole, schema)
    dense = dense.select("table", "level", F.lit(None).cast(kind["row_id"]).alias("row_id"), F.col("centre").alias("x"), F.lit(None).cast("double").alias("y"), "w")
    return rows.where("n is null").select("table", "level", "row_id", "x", "y", F.lit(None).cast("array<double>").alias("w")).unionByName(dense)


def attend(stored: StoredContext, queries: DataFrame, piece: int = PIECE, most: int = SETS, worth: int = WORTH) -> DataFrame:
    """table, row_id, output: class shares, or a weighted target, of the query rows of tables of any size. queries: table, row_id,
    x; a row_id is one row of its table.

    Query rows are dealt into sets, and a table's context into chunks while there are fewer sets than tasks. A task holds a set,
    and streams a chunk of the context past it, a piece at a time, keeping each row's softmax state: the largest product, the sum
    of weights, and the weighted values. States of chunks are merged by row. What is shuffled is the query rows once a chunk (no
    more chunks than tasks over sets) and the context once a set: neither side is copied for every pair of pieces.

    Query rows of a narrow table go by levels of their size. A level of `worth` query rows or more, in a table of as many context
    rows, meets the context as summed() gives it: few rows of a cell, or its sums. The others meet the context's rows (level -1).
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = _scaled(queries.select("table", "row_id", F.col("x").cast("array<double>").alias("x")), stored.facts)
    queries = written(queries.withColumn("size", F.when(F.size("x").between(1, NARROW), _level(F.col("x"))).otherwise(-1)), "queries")
    # a row per table and size of its query rows, of which there are ten at most
    levels = queries.groupBy("table", "size").agg(F.count("*").alias("n")).join(stored.facts.select("table", "n_context"), "table")
    levels = written(levels.withColumn("level", F.when((F.col("n") >= worth) & (F.col("n_context") >= worth), F.col("size")).otherwise(-1)), "levels")
    context = stored.rows.select("table", F.lit(-1).alias("level"), "row_id", "x", "y", F.lit(None).cast("array<double>").alias("w"))
    lengths = stored.facts.select("table", F.lit(-1).alias("level"), "n_context")
    fine = levels.where("level >= 0").select("table", "level")
    if fine.first() is not None:
        sums = written(summed(stored, fine), "sums")
        context = context.unionByName(sums)
        lengths = lengths.unionByName(sums.groupBy("table", "level").agg(F.count("*").alias("n_context")))
    sizes = levels.groupBy("table", "level").agg(F.ceil(F.sum("n") / most).cast("int").alias("sets"))
    all_sets = sizes.agg(F.sum("sets")).first()[0] or 1
    sizes = sizes.join(lengths, ["table", "level"]).select("table", "level", "sets", F.greatest(F.lit(1), F.least(F.ceil(F.col("n_context") / piece), F.lit(-(-parts // all_sets)))).cast("int").alias("chunks"))

    def dealt(d: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        d = d.join(sizes, ["table", "level"])
        d = d.withColumn(own, F.pmod(F.xxhash64(*by), F.col(f"{own}s")).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    key = ["table", "level", "set", "chunk", "kind"]
    own = queries.join(levels.select("table", "size", "level"), ["table", "size"]).select("table", "level", "row_id", "x")
    both = dealt(own, "set", "chunk", "row_id").select(*key[:-1], F.lit(0).alias("kind"), "row_id", "x", F.lit(None).cast("double").alias("y"), F.lit(None).cast("array<double>").alias("w"))
    kind = F.when(F.col("w").isNull(), 1).otherwise(2)
    both = both.unionByName(dealt(context, "chunk", "set", "row_id", "x").select(*key[:-1], kind.alias("kind"), "row_id", "x", "y", "w"))
    both = both.repartition(parts, *key[:-1]).sortWithinPartitions(*key, "row_id", "x")
    width, classes = stored.n_values, stored.classes
    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("table", "row_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, cells, state = None, [], [], [], None

        def push() -> None:
            """Streams the waiting context rows and cells past the set."""
            nonlocal state
            if (waiting or cells) and held:
                if state is None:
                    q = np.concatenate([matrix(x) for _, _, x in held])
                    state = [q, np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros((len(q), width))]
                if waiting:
                    y = np.concatenate([v for _, v in waiting])
                    value = np.eye(width)[y.astype(int)] if classes else y[:, None]
                    stream(np.concatenate([matrix(x) for x, _ in waiting]), lambda s, rows: (s.sum(1), s @ value))
                if cells:
                    c, sums = (np.concatenate([matrix(p[k]) for p in cells]) for k in (0, 1))
                    sums = sums.reshape(len(c) * (width + 1), -1).T

                    def seen(s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                        """Of each query row and cell its weight by the centre, times the product of powers."""
                        got = kernel.monomials(rows / 2.0 ** now[1], DEGREE).T @ sums
                        got = (s[:, None] @ got.reshape(len(rows), len(c), -1))[:, 0]
                        return got[:, -1], got[:, :-1]

                    stream(c, seen, ROWS)
            waiting.clear()
            cells.clear()

        def stream(c: np.ndarray, seen: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rows: int = TILE) -> None:
            q, top, total, votes = state
            step = max(1, min(rows, TILE // len(c)))
            for a in range(0, len(q), step):
                own = slice(a, a + step)
                s = q[own] @ c.T
                s /= np.sqrt(c.shape[1])
                new = np.maximum(top[own], s.max(1))
                old = np.exp(top[own] - new)
                s -= new[:, None]
                np.exp(s, out=s)
                more, voted = seen(s, q[own])
                total[own] = total[own] * old + more
                votes[own] = votes[own] * old[:, None] + voted
                top[own] = new

        def told() -> pa.RecordBatch:
            push()
            tables = pa.concat_arrays([t for t, _, _ in held])
            _, top, total, votes = state or (None, np.full(len(tables), -np.inf), np.zeros(len(tables)), np.zeros((len(tables), width)))
            return pa.RecordBatch.from_arrays([tables, pa.concat_arrays([r for _, r, _ in held]), pa.array(top), pa.array(total), pa.array(list(votes), pa.list_(pa.float64()))], names=["table", "row_id", "most", "total", "votes"])

        for b in batches:
            for k, rows in _runs(b, key):
                if k[:4] != now:
                    if held:
                        yield told()
                    now, state = k[:4], None
                    held.clear()
                    waiting.clear()
                    cells.clear()
                if k[4] == 0:
                    held.append((rows.column("table"), rows.column("row_id"), rows.column("x")))
                    continue
                if k[4] == 1:
                    waiting.append((rows.column("x"), rows.column("y").to_numpy(zero_copy_only=False)))
                    if sum(len(v) for _, v in waiting) >= piece:
                        push()
                    continue
                for a in range(0, rows.num_rows, CELLS):
                    cells.append((rows.column("x").slice(a, CELLS), rows.column("w").slice(a, CELLS)))
                    if sum(len(v) for v, _ in cells) >= CELLS:
                        push()
        if held:
            yield told()

    found = both.mapInArrow(run, f"table {kinds['table']}, row_id {kinds['row_id']}, most double, total double, votes array<double>")
    # the states of a row's chunks, as many as there are tasks over sets at most
    found = found.groupBy("table", "row_id").agg(F.collect_list(F.struct("most", "total", "votes")).alias("s"), F.max("most").alias("top"))
    weight = lambda x: F.when(F.col("top") == float("-inf"), 1.0).otherwise(F.exp(x.most - F.col("top")))
    whole = F.aggregate("s", F.lit(0.0), lambda a, x: a + x.total * weight(x))
    added = F.aggregate("s", F.array_repeat(F.lit(0.0), width), lambda a, x: F.zip_with(a, x.votes, lambda v, w: v + w * weight(x)))
    found = found.select("table", "row_id", whole.alias("whole"), added.alias("added"))
    return found.select("table", "row_id", F.transform("added", lambda v: F.when(F.col("whole") > 0, v / F.col("whole")).otherwise(F.lit(float("nan")))).alias("output"))


def attend_table(context: DataFrame, queries: DataFrame, piece: int = PIECE, most: int = SETS) -> DataFrame:
    """row_id, output: attention_scorer's class shares for the query rows of one table of any size. context: row_id, x, y (0, 1,
    ...); queries: row_id, x. A row_id is one row."""
    top = context.agg(F.max("y")).first()[0]
    if top is None:
        return queries.select("row_id", F.array(F.lit(float("nan"))).alias("output"))
    stored = store_context(context.withColumn("table", F.lit(0)), int(top) + 1)
    return attend(stored, queries.withColumn("table", F.lit(0)), piece, most).drop("table")

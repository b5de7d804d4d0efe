"""Conversation repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by square-root checkpointed DP.

The DP's state is what the roles so far end with: nothing (0), a system turn (1), a user turn (2), an assistant turn (3). A
vector holds the cost to the end from each state. Vectors are computed backward, and stored at checkpoints alone: between the
blocks of a conversation and, inside a block, at about the square root of its rows. Walking forward, the vectors from one
checkpoint to the next are computed again, and of the tight edits (those that keep to the cost) the ASCII-least is taken; in a
state each edit leads to one state, so this is the least string.

On Spark a conversation may be of any size. Rows are range-partitioned in order once. A block is a run of at most about the
square root of the largest conversation's rows. Each block gives a min-plus matrix of its costs from state to state; a
conversation's matrices (a few numbers a block) give the vectors between its blocks; each block is then walked from each state
that it may begin in, and a conversation's blocks are chained. Only the digest of a conversation reads its rows one after the
other, as a stream, since SHA-256 has no other way.

Faults, the first that a row has: blank (no word), duplicate (role and text occur earlier in the conversation), truncated (the
last character but for space is none of .!?). Edits: keep (K, 0), rerole to user or assistant (R, 1), delete (D, 2, the only
one for blank and duplicate rows), insert an empty turn of user or assistant (I, 5); a truncated row that stays costs 5 more.

Cases: null roles and texts are one space, and so are null ids and turns in the draw of the damage; rows without a conv_id are
one conversation. Null turns come first; rows of one turn are ordered by role, then text, by their bytes. Rows that repeat are
rows of their own (and duplicates). An empty table gives no rows. Very long texts are read whole. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabmill.llm.text import shared_table

#: Least rows of a block, so that conversations of common size are one block.
LEAST_BLOCK = 256
FAR = 1 << 60
#: State after a role of this initial (s, u, a, any other), or none.
AFTER = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The role that an inserted or reroled turn has in a state, and the state after it.
ROLE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: Bits of a row's code beside its initial.
TRUNCATED, GONE = 4, 8
Vector = tuple[int, int, int, int]


def with_inserts(v: list[int] | Vector) -> Vector:
    """Costs when turns may be inserted first."""
    user, assistant = min(v[2], 5 + v[3]), min(v[3], 5 + v[2])
    return min(v[0], 5 + user), min(v[1], 5 + user), user, assistant


#: Costs behind the last row.
END = with_inserts((0, FAR, FAR, 0))


def before(code: int, after: Vector) -> Vector:
    """Costs in front of a row, from those behind it. Linear in (min, +)."""
    v = [2 + x for x in after]
    if not code & GONE:
        more = 5 if code & TRUNCATED else 0
        for q in range(4):
            kept = AFTER[q][code & 3]
            if kept is not None:
                v[q] = min(v[q], more + after[kept])
            v[q] = min(v[q], more + 1 + after[NEXT[q]])
    return with_inserts(v)


def matrix(codes: bytes) -> list[int]:
    """16 costs: from each state before a block to each state behind it."""
    columns = []
    for j in range(4):
        v = tuple(0 if q == j else FAR for q in range(4))
        for c in reversed(codes):
            v = before(c, v)
        columns.append(v)
    return [min(columns[j][q], FAR) for q in range(4) for j in range(4)]


def walk(codes: bytes, end: Vector, last: bool, entries: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[str, str, int]]:
    """Of a block, from each entry: the ASCII-least tight edits, the initial of each edit's new role (or a space), and the state
    behind the block. end: costs behind the block; last: nothing follows, so turns inserted at the end are this block's."""
    n, step = len(codes), isqrt(len(codes)) + 1
    marks, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % step == 0:
            marks[i] = v
    states, made = list(entries), [([], []) for _ in entries]
    for a in range(0, n, step):
        b = min(a + step, n)
        again = [marks[b]]
        for i in range(b - 1, a - 1, -1):
            again.append(before(codes[i], again[-1]))
        again.reverse()
        for k, (edits, roles) in enumerate(made):
            q = states[k]
            for i in range(a, b):
                code, here, after = codes[i], again[i - a], again[i - a + 1]
                more = 5 if code & TRUNCATED else 0
                while here[q] != 2 + after[q] and here[q] == 5 + here[NEXT[q]]:
                    edits.append("I")
                    roles.append(ROLE[q][0])
                    q = NEXT[q]
                kept = AFTER[q][code & 3]
                if here[q] == 2 + after[q]:
                    edits.append("D")
                    roles.append(" ")
                elif kept is not None and here[q] == more + after[kept]:
                    edits.append("K")
                    roles.append(" ")
                    q = kept
                else:
                    edits.append("R")
                    roles.append(ROLE[q][0])
                    q = NEXT[q]
            states[k] = q
    if last:
        for k, (edits, roles) in enumerate(made):
            while end[states[k]]:
                edits.append("I")
                roles.append(ROLE[states[k]][0])
                states[k] = NEXT[states[k]]
    return [("".join(edits), "".join(roles), q) for (edits, roles), q in zip(made, states, strict=True)]


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with nulls of role and text as one space, damaged by the hash of id and turn:
    rows dropped, emptied, without ends of sentences, repeated, or the user's. order_role, order_text: as they were."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    d = conversations.select("conv_id", "turn", space("role").alias("order_role"), space("text").alias("order_text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("order_text", ".!?", "")).otherwise(F.col("order_text"))
    d = d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("order_role")).alias("role"), text.alias("text"), "order_role", "order_text", "_kind")
    again = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("_copy", F.explode(again)).drop("_kind", "_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, blank, truncated, initial, digest and each row's place: _part, _at. Written, since ranges are
    sampled. Rows that agree in all are told apart by where they were read, so that no range holds them all."""
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), *(F.col(c) for c in ("order_role", "order_text") if c in rows.columns))
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn")] + [F.col(c) for c in (("order_role", "order_text") if "order_role" in d.columns else ("role", "text"))]
    d = d.withColumn("_read", F.monotonically_increasing_id())
    d = d.repartitionByRange(*keys, "_read").sortWithinPartitions(*keys, "_read")
    d = d.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    d = d.select("conv_id", "turn", "role", "text", "_part", "_at", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), initial.alias("initial"))
    digest = F.when(~F.col("blank"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    return shared_table(d.withColumn("digest", digest), "turns")


def blocks_of(turns: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """A row per block: conv_id, part, at (its first row's place), codes (a byte a row), costs (its matrix), first and last
    initial, and counts of faults and of illegal neighbours. Written."""
    most = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    size = max(least, isqrt(most) + 1)
    # the first of equal turns, by place: the others are duplicates
    firsts = turns.where("digest is not null").groupBy("conv_id", "digest").agg(F.min(F.struct("_part", "_at")).alias("f"))
    code = F.col("initial") + F.when(F.col("blank"), 16).when(F.col("truncated"), TRUNCATED).otherwise(0)
    both = turns.select("conv_id", "_part", "_at", code.alias("code")).unionByName(firsts.select("conv_id", "f._part", "f._at", F.lit(-1).alias("code")))
    grouped = both.groupBy("conv_id", "_part", F.floor(F.col("_at") / size).alias("_block")).agg(F.collect_list(F.struct("_at", "code")).alias("rows"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, lists = b.column("conv_id"), b.column("_part"), b.column("rows").to_pylist()
            out = []
            for rows in lists:
                first = {r["_at"] for r in rows if r["code"] < 0}
                own = sorted((r["_at"], r["code"]) for r in rows if r["code"] >= 0)
                blank, duplicate, truncated, codes = 0, 0, 0, bytearray()
                for at, c in own:
                    if c & 16:
                        blank += 1
                        c = c & 3 | GONE
                    elif at not in first:
                        duplicate += 1
                        c = c & 3 | GONE
                    elif c & TRUNCATED:
                        truncated += 1
                    codes.append(c)
                illegal = sum((x & 3, y & 3) not in LEGAL for x, y in zip(codes, codes[1:], strict=False))
                out.append((own[0][0], bytes(codes), matrix(bytes(codes)), codes[0] & 3, codes[-1] & 3, blank, duplicate, truncated, illegal))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, parts, *columns], names=["conv_id", "part", "at", "codes", "costs", "first", "last", "blank", "duplicate", "truncated", "illegal"])

    schema = f"conv_id {kind}, part int, at long, codes binary, costs array<long>, first int, last int, blank long, duplicate long, truncated long, illegal long"
    return shared_table(grouped.select("conv_id", "_part", "rows").mapInArrow(run, schema), "blocks")


#: Neighbouring initials that may be: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def checkpoints(blocks: DataFrame) -> DataFrame:
    """A row per conversation: its counts, its cost, and `ends`: by block, the costs behind it, and whether it is the first and
    the last. Gathers a few numbers a block."""
    thin = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "costs", "first", "last", "illegal"))).alias("b"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    kind = blocks.schema["conv_id"].dataType.simpleString()
    end = pa.struct([("part", pa.int32()), ("at", pa.int64()), ("end", pa.list_(pa.int64())), ("opens", pa.bool_()), ("closes", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            illegal, cost, ends = [], [], []
            for own in b.column("b").to_pylist():
                v, out = END, []
                for k in range(len(own) - 1, -1, -1):
                    out.append({"part": own[k]["part"], "at": own[k]["at"], "end": list(v), "opens": k == 0, "closes": k == len(own) - 1})
                    m = own[k]["costs"]
                    v = tuple(min(m[4 * q + j] + v[j] for j in range(4)) for q in range(4))
                illegal.append(sum(x["illegal"] for x in own) + sum((x["last"], y["first"]) not in LEGAL for x, y in zip(own, own[1:], strict=False)))
                cost.append(v[0])
                ends.append(out)
            columns = [b.column("conv_id"), *(b.column(c) for c in ("blank", "duplicate", "truncated")), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(ends, pa.list_(end))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "ends"])

    ends = "array<struct<part: int, at: bigint, end: array<bigint>, opens: boolean, closes: boolean>>"
    return shared_table(thin.mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, ends {ends}"), "checkpoints")


def edits_of(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """conv_id, part, at, k, edit, new_role: a row's edit, and turns inserted in front of it (smaller k); behind a conversation's
    last row, place `at` is the next one."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    ends = marks.select(F.explode("ends").alias("e")).select("e.*")
    walked = blocks.select("conv_id", "part", "at", "codes").join(ends, ["part", "at"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            four = zip(*(b.column(c).to_pylist() for c in ("codes", "end", "opens", "closes")), strict=True)
            found = [walk(codes, tuple(end), last, (0,) if first else (0, 1, 2, 3)) for codes, end, first, last in four]
            own = [pa.array([[f[k] for f in each] for each in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("at"), *own], names=["conv_id", "part", "at", "edits", "roles", "exits"])

    walked = shared_table(walked.mapInArrow(every, f"conv_id {kind}, part int, at long, edits array<string>, roles array<string>, exits array<int>"), "walked")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column("b").to_pylist():
                q = 0
                for x in own:
                    out.append((x["part"], x["at"], q))
                    q = x["exits"][q]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32()))], names=["part", "at", "entry"])

    # each block is entered in the state that the one before it ends in
    entered = walked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "exits"))).alias("b")).select("b").mapInArrow(chained, "part int, at long, entry int")
    taken = walked.join(entered, ["part", "at"]).select("conv_id", "part", "at", F.get("edits", F.col("entry")).alias("edits"), F.get("roles", F.col("entry")).alias("roles"))

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ats, ks, edits, roles = [], [], [], [], []
            for i, (at, own, new) in enumerate(zip(*(b.column(c).to_pylist() for c in ("at", "edits", "roles")), strict=True)):
                k = 0
                for e, r in zip(own, new, strict=True):
                    rows.append(i)
                    ats.append(at)
                    ks.append(k)
                    edits.append(e)
                    roles.append({"u": "user", "a": "assistant"}.get(r))
                    at, k = (at, k + 1) if e == "I" else (at + 1, 0)
            i = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(i), b.column("part").take(i), pa.array(ats, pa.int64()), pa.array(ks, pa.int32()), pa.array(edits, pa.string()), pa.array(roles, pa.string())], names=["conv_id", "part", "at", "k", "edit", "new_role"])

    return taken.mapInArrow(by_row, f"conv_id {kind}, part int, at long, k int, edit string, new_role string")


def repair(rows: DataFrame, least: int = LEAST_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The edits and the facts of conversations (conv_id, turn, role, text).

    Edits: conv_id, part, at, k (which order a conversation's edits), edit, role, text; a deleted row has its own role and text.
    Facts, a row per conversation: conv_id, blank, duplicate, truncated, illegal, cost.
    """
    turns = in_order(rows)
    blocks = blocks_of(turns, least)
    marks = checkpoints(blocks)
    own = turns.select(F.col("_part").alias("part"), F.col("_at").alias("at"), "role", "text")
    edits = edits_of(blocks, marks)
    of_rows = edits.where("edit <> 'I'").join(own, ["part", "at"]).select("conv_id", "part", "at", "k", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    made = edits.where("edit = 'I'").select("conv_id", "part", "at", "k", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return of_rows.unionByName(made), marks.drop("ends")


def repaired(edits: DataFrame) -> DataFrame:
    """The turns that repair()'s edits leave, without a place of their own kind: conv_id, part, at, k, role, text."""
    return edits.where("edit <> 'D'").drop("edit")


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit (the edits' initials), repaired_sha256 (of the lines role:text), from repair()'s edits as a sorted stream: a
    task holds one batch, a hash's state and an audit."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    d = edits.select("conv_id", "part", "at", "k", "edit", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, audit, digest, lines = nothing, [], hashlib.sha256(), 0
        for b in batches:
            out = []
            for conv, edit, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "line")), strict=True):
                if now is nothing or conv != now:
                    if now is not nothing:
                        out.append((now, "".join(audit), digest.hexdigest()))
                    now, audit, digest, lines = conv, [], hashlib.sha256(), 0
                audit.append(edit)
                if text is not None:
                    digest.update(("\n" + text if lines else text).encode())
                    lines += 1
            yield pack(out, b.schema.field("conv_id").type)
            of = b.schema.field("conv_id").type
        if now is not nothing:
            yield pack([(now, "".join(audit), digest.hexdigest())], of)

    def pack(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], of), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["conv_id", "audit", "repaired_sha256"])

    return d.select("conv_id", "edit", "line").mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id, gaps: turns missing between a conversation's least and largest."""
    by = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("*").alias("n"))
    return by.select("conv_id", (F.col("b") - F.col("a") + 1 - F.col("n")).cast("long").alias("gaps"))


def report(conversations: DataFrame, rows: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """A row for each conv_id of conversations: gaps, faults, cost, audit and digest of what repair() makes of rows; zeros, no edits
    and nothing's hash if no row of it is left."""
    edits, facts = repair(rows, least)
    # one aggregation instead of joins, so that rows without an id are one conversation like any other
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select("conv_id").distinct(), gaps(rows), facts, digests(edits)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    empty = hashlib.sha256().hexdigest()
    out = every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
    return out

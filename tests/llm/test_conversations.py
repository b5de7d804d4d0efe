from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from tabmill.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rows(rows):
    """Rows by conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode())):
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """All of a conversation's answers, by costs and strings of every suffix from every state."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = lambda s: re.fullmatch(r"(s?(ua)*u?)?", s)  # noqa: E731  what may become (s?(ua)+)?

    @functools.lru_cache(maxsize=None)
    def best(i, state, inserted=0):
        """(cost, edits, lines) from row i on; state: the initials so far, shortened."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "ua") else []
        short = lambda s: s if len(s) < 3 and not s.startswith("ua") else "ua" if s.endswith("a") else "u"

        def add(cost, edit, nxt, after, line):
            if after is not None:
                c, e, lines = best(*nxt, after) if edit != "I" else best(*nxt, after, inserted + 1)
                options.append((cost + c, edit + e, line + lines))

        def plus(role):
            initial = role[:1]
            if initial not in ("s", "u", "a"):
                return None
            s = state + initial
            return short(s.removeprefix("s") if s != "s" else s) if legal(s) else None

        if inserted < 3:
            for role in ("user", "assistant"):
                add(5, "I", (i,), plus(role), (f"{role}:",))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", (i + 1,), state, ())
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                add(more, "K", (i + 1,), plus(role), (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    add(more + 1, "R", (i + 1,), plus(new), (f"{new}:{text}",))
        return min(options) if options else (1 << 40, "", ())

    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    count = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def answers(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.select(columns).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def drawn(seed, n, longest):
    r = random.Random(seed)
    texts = ["Good.", "So?", "no end", " ", "", None, "Yes!\n", "Long " * 400 + ".", "Ünï."]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            rows.append((conv if conv else None, turn * r.choice([1, 1, 1, 2]) if r.random() < 0.95 else None, r.choice(["system", "user", "assistant", "user", "assistant", "", "tool", None]), r.choice(texts) if r.random() < 0.4 else f"Text {r.randint(0, 50)}."))
    return rows


@pytest.mark.parametrize("least", [1, 3, 256])
def test_repair_against_every_suffix(spark, least):
    rows = drawn(least, 40, 9) + [(77, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = answers(conversations.report(df, conversations.damaged(df), least=least))
    want = {c: plain_repair(own) for c, own in plain_rows(rows).items()}
    assert got == want


def test_blocks_of_a_long_conversation_agree_with_one_block(spark):
    r = random.Random(7)
    rows = [(5, k // 2, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c!", f"{k}."])) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = conversations.report(df, conversations.damaged(df), least=10_000).collect()
    assert one == conversations.report(df, conversations.damaged(df), least=1).collect()
    codes = bytes(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 10]) for _ in range(400))
    v = conversations.END
    for c in reversed(codes):
        v = conversations.before(c, v)
    m = conversations.matrix(codes)
    assert v == tuple(min(m[4 * q + j] + conversations.END[j] for j in range(4)) for q in range(4))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = answers(queries.op11_conversation_repair(spark, sf))
    want = {c: plain_repair(own) for c, own in plain_rows(rows).items()}
    assert got == want and len(got) > 10
    assert any("I" in g[6] for g in got.values()) or any("R" in g[6] for g in got.values())


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, conversations.damaged(empty)).count() == 0
    # conversations of which nothing is left, rows that repeat, extra columns with names of the operator's own
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x.", 1, "y"), (None, None, None, None, 2, "y"), (None, None, "user", "A.", 3, "y"), (None, None, "user", "A.", 3, "y"), (3, None, "user", "A.", 3, "y")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, cost int, audit string")
    got = answers(conversations.report(df, conversations.damaged(df)))
    assert got == {c: plain_repair(own) for c, own in plain_rows([r[:4] for r in rows]).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_have_the_roles_wanted(spark):
    rows = drawn(11, 30, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    edits, _ = conversations.repair(df)
    roles = {}
    for r in sorted(conversations.repaired(edits).collect(), key=lambda r: (r.part, r.at, r.k)):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert roles and all(re.fullmatch(r"(s?(ua)+)?", s) for s in roles.values())

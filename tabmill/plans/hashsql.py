"""The hashed draws of tabmill.functions.numbers.uniform as DuckDB SQL, from XXH64's public definition.

Spark hashes several values one after another, each with the hash before it as its seed. Leading literals are hashed here; the
columns are hashed in SQL, on 128-bit numbers taken modulo 2^64. `let` names a value by a lambda, so that no expression is
written out twice.
"""

from __future__ import annotations

import itertools
import struct

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
FULL = 1 << 64
_names = itertools.count()


def _big(v: int | str) -> str:
    return f"{v}::UHUGEINT"


def let(value: str, body) -> str:
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _times(a: str, p: int) -> str:
    return f"(({a}) * {_big(p)} % {_big(FULL)})"


def _turn(a: str, bits: int) -> str:
    return let(a, lambda v: f"(({v} * {_big(1 << bits)}) % {_big(FULL)} + {v} // {_big(1 << (64 - bits))})")


def _mix(h: str) -> str:
    for shift, p in ((33, P2), (29, P3), (32, None)):
        h = let(h, lambda v, s=shift: f"xor({v}, {v} // {_big(1 << s)})")
        h = _times(h, p) if p else h
    return h


def hash_sql(seed: str, value: str, kind: str) -> str:
    """The hash of a number that isn't negative, as UHUGEINT. kind: int or long, as Spark has the column."""
    if kind == "int":
        h = let(f"({seed} + {_big(P5)} + 4) % {_big(FULL)}", lambda v: f"xor({v}, {_times(f'({value})::UHUGEINT', P1)})")
        return _mix(f"(({_times(_turn(h, 23), P2)} + {_big(P3)}) % {_big(FULL)})")
    k = _times(_turn(_times(f"({value})::UHUGEINT", P2), 31), P1)
    h = let(f"({seed} + {_big(P5)} + 8) % {_big(FULL)}", lambda v: f"xor({v}, {k})")
    return _mix(f"(({_times(_turn(h, 27), P1)} + {_big(P4)}) % {_big(FULL)})")


def uniform_sql(*parts: int | str | tuple[str, str]) -> str:
    """A draw in [0, 1). Leading ints and texts are literals; (SQL expression, 'int' or 'long') are columns."""
    import xxhash

    seed, k = 42, 0
    while k < len(parts) and not isinstance(parts[k], tuple):
        p = parts[k]
        seed = xxhash.xxh64_intdigest(struct.pack("<i", p) if isinstance(p, int) else p.encode(), seed)
        k += 1
    out = _big(seed)
    for value, kind in parts[k:]:
        out = hash_sql(out, value, kind)
    return f"({out} // {_big(1 << 11)})::DOUBLE / 9007199254740992.0"

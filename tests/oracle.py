"""Runs registered queries beside their SQL in DuckDB, as the driver does: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, name: str, f, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    got = f(spark, sf_dir)
    mine = rows_of(got.columns, got.collect())
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if len(mine) != len(want):
        return f"{len(mine)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(mine, want, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows, as {bad[0]}" if bad else ""

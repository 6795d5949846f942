"""Runs a registered query and its SQL on the same tables and compares the results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if hasattr(value, "is_integer") and not isinstance(value, int):
        return repr(float(value))
    return repr(value)


def _sorted(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """Empty when names, row counts and all values agree."""
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    ours, theirs = _sorted(df.columns, df.collect()), _sorted(names, rows)
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows"]
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return [f"{len(bad)} of {len(ours)} rows differ"] + [
        f"spark {str(a)[:400]}\n sql   {str(b)[:400]}" for a, b in bad[:2]
    ] if bad else []

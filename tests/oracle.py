"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value == int(value) else float(f"{value:.9g}"))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, query, sql: str | None) -> tuple[str | None, int, float]:
    """(problem or None, rows, seconds)."""
    start = time.time()
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(got), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got), took
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else got[:1]
        only_want = [r for r in want if r not in set(got)][:2] if len(want) < 20000 else want[:1]
        return f"{len(got)} vs {len(want)} rows; spark {only_got} oracle {only_want}", len(got), took
    return None, len(got), took

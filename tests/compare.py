"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """Empty when the DataFrame and the SQL agree; else a short account."""
    got_rows = [tuple(r) for r in df.collect()]
    want = con.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_rows = want.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got, expected = normalized(df.columns, got_rows), normalized(want_columns, want_rows)
    if got == expected:
        return ""
    extra = [r for r in got if r not in set(expected)][:3]
    lacking = [r for r in expected if r not in set(got)][:3]
    return f"{len(got)} rows, expected {len(expected)}; only here {extra}; only there {lacking}"

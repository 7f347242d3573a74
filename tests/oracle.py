"""Running a query and its oracle side by side."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if hasattr(x, "item"):
        return _plain(x.item())
    return x


def rows(names: list[str], data: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"

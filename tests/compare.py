"""Run a query on Spark and its SQL on DuckDB and compare rows as multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


def differences(df, sql: str, con) -> str | None:
    """None when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = rows_of(names, result.fetchall())
    if got == want:
        return None if got else "empty on both sides"
    only_got, only_want = got - want, want - got
    return (
        f"{sum(got.values())} rows / {sum(want.values())}; {sum(only_got.values())} differ\n"
        f"{sorted(names)}\n spark {list(only_got)[:4]}\n sql   {list(only_want)[:4]}"
    )

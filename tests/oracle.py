"""Comparison of results with those of SQL over the same tables, as bags of rows."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, Decimal):
        return f"{v.normalize():f}" if v else "0"
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def bag(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def spark_bag(df) -> Counter:
    return bag(df.columns, df.collect())


def sql_bag(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, bag(names, cur.fetchall())

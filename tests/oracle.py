"""Holds a query's rows against its SQL, run by DuckDB over the same files."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, sf, query, text):
    found = query(spark, sf)
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    want = con.execute(text)
    names = [d[0] for d in want.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, want.fetchall())

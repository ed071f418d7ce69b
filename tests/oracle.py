"""Compares a query of the engine with SQL run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def database(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return db


def assert_same(frame, db, sql):
    rows, columns = frame.collect(), sorted(frame.columns)
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    got = Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

"""Compare a query with its SQL in DuckDB: rows as multisets, columns by name, doubles to 6 significant places."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, list]:
    """The number of rows and the first rows that only one side has."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == names, (sorted(rel.columns), names)
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    return sum(ours.values()), [*list((ours - theirs).items())[:3], "|", *list((theirs - ours).items())[:3]] if ours != theirs else []

"""Run a query and its SQL over the same tables and compare them as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{Path(sf_dir) / t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(v[i]) for i in order) for v in values)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, map(tuple, df.collect()))
    rel = connect(sf_dir).sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"

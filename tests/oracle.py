"""Compares every query that has SQL with DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf: str, query, sql: str) -> None:
    df = query(spark, sf)
    c1, got = rows(df.columns, df.collect())
    r = con.execute(sql)
    c2, want = rows([d[0] for d in r.description], r.fetchall())
    assert c1 == c2, (c1, c2)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]

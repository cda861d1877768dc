"""Comparing a registered query with its SQL on the given tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"
HERE = os.path.isdir(FOLDER)


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 9) if abs(x) < 1e6 else round(x, 3)
    return x if isinstance(x, (bool, int, str, bytes)) else str(x)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([cell(r[i]) for i in at]) for r in rows)


def agree(spark, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = query(spark, FOLDER)
    want = db.sql(sql)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())

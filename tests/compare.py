"""Runs a query and its SQL over the same tables and compares the rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def differences(spark, con, query, sql, sf_dir):
    """(rows only in Spark, rows only in SQL), with columns sorted by name."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns, (sorted(result.columns), columns)
    order = [result.columns.index(c) for c in columns]
    got = Counter(map(tuple, df.select(columns).collect()))
    want = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    return got - want, want - got

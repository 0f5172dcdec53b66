"""Compare a query with its SQL, order aside, as exact values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def differences(df, c, sql: str):
    """(only in Spark, only in SQL, rows)."""
    from collections import Counter

    r = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(r.columns), (names, sorted(r.columns))
    mine = Counter(tuple(plain(x[n]) for n in names) for x in df.collect())
    at = [r.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    return list((mine - theirs).items())[:3], list((theirs - mine).items())[:3], sum(theirs.values())

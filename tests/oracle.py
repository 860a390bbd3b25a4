"""Comparing a query with its SQL over the same parquet tables."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def _plain(x):
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(t[i]) for i in order) for t in tuples), key=repr)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = connect(folder).execute(sql)
    names = [d[0] for d in relation.description]
    want = rows(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b

"""Runs a query and its SQL twin and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def differing(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = [tuple(map(_plain, r)) for r in df.select(*names).collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    want = [tuple(_plain(x[i]) for i in at) for x in r.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b))]

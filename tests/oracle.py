"""Spark's rows against those of the SQL on the same tables."""

import os

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def differing(spark, con, query, sql):
    """Rows of either side only."""
    df = query(spark, DATA)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return [] if own == theirs else [[x for x in own if x not in theirs][:3], [x for x in theirs if x not in own][:3], len(own), len(theirs)]

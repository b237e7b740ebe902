"""Compares registered queries with their DuckDB SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(x) for x in cols]
    assert ours == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())

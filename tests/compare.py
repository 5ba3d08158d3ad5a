"""Runs a query's SQL in DuckDB and compares all rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows_of(names, rel.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
    return len(got)

"""Spark results against DuckDB's, without regard to order."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir=SF):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def normal(v):
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, list):
        return tuple(normal(x) for x in v)
    return (type(v).__name__, str(v))


def check(spark, run, sql, sf_dir=SF):
    df = run(spark, sf_dir)
    cur = connection(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(normal(dict(zip(names, r))[n]) for n in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(normal(r[n]) for n in sorted(names)) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]

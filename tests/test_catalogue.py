"""Every core query on the smallest tables against its oracle, and on empty tables."""

import glob
import math
import os

import duckdb
import pytest

from turnloom.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for p in glob.glob(small_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small_dir, duck, name):
    df = catalogue.QUERIES[name](spark, small_dir)
    cols = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()))
    if name not in catalogue.SQL:
        return
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())

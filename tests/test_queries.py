"""Registered queries against their SQL."""

import math

import duckdb
import pytest
from itemloom.plans import bank_queries, draft_queries, queries

SF = "/root/testdata/sf0.001"
assert draft_queries.query is bank_queries.query is queries.query
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        return
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and len(got) == len(want)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

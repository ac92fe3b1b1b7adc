"""Every registered query runs, and equals its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalog
from brindle.session import TABLES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.SQL:
        result = duck.execute(catalog.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

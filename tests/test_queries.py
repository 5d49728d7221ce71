"""Every registered query against its SQL on the smallest tables."""
import numbers

import pandas as pd
import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return float(x) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, duck, name):
    got = E.queries()[name](spark, FOLDER).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0 and rows(got) == rows(want)


def test_entry(spark):
    assert E.entry(spark).count() > 0

"""Every query against its SQL twin."""

import datetime
import os

import duckdb
import pytest

from tallyweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(want.columns, want.fetchall())
    assert got


def test_flagship(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["year", "label", "amount"]
    assert set(QUERIES) <= set(__spark_entry__.queries())

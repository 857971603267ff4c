"""Every query with an oracle gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from selvedge.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = duck.sql(registry.ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got = rows(ours.columns, [tuple(r) for r in ours.collect()])
    expected = rows(theirs.columns, theirs.fetchall())
    assert got == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0

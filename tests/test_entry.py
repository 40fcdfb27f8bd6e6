"""The driver's contract: queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from glossweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_registry():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.ORACLES[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.columns) == names
    assert rows(got) == sorted(str(tuple(r[c] for c in names)) for r in want.to_pylist())

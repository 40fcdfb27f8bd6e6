"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from glossweave.llm import queries


def rows(found, names):
    return sorted(str(tuple(r[c] for c in names)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, sf)
    names = sorted(want.column_names)
    assert sorted(got.columns) == names
    assert rows(got.collect(), names) == rows(want.to_pylist(), names)

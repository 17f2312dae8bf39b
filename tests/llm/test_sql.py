"""Every text query that has SQL, against it."""

import duckdb
import pytest

from driftlake.llm import registry

TABLES = ("documents", "pages", "conversations", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    at = [want.columns.index(c) for c in cols]
    assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)

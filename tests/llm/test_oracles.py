"""Queries with SQL agree with DuckDB on the small test tables."""

import os

import pytest
from tallyforge.llm import entries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("key", entries.oracle_sql())
def test_matches(spark, key):
    c = pytest.importorskip("duckdb").connect()
    for t in os.listdir(DIR):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    df = entries.queries()[key](spark, DIR)
    r = c.execute(entries.oracle_sql()[key])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(x)) for x in df.select(*columns).collect()) == sorted(repr(x) for x in r.fetchall())

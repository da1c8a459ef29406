"""Queries that SQL can express against that SQL, in DuckDB."""

import os

import duckdb
import pytest

from tessella.llm import queries as llm


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = llm.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    want = con.sql(llm.ORACLES[name])
    assert columns == sorted(want.columns)
    assert sorted(map(str, rows)) == sorted(map(str, want.select(*columns).fetchall()))

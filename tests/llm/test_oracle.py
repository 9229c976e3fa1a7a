from __future__ import annotations

import duckdb

from siteloom.llm import registry


def test_quote_linking_matches_sql(spark):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{root}/conversations.parquet'")
    expected = con.sql(registry.oracle_sql()["op5_quote_linking"])
    found = registry.queries()["op5_quote_linking"](spark, root)
    assert sorted(found.columns) == sorted(expected.columns)
    assert {tuple(x[c] for c in expected.columns) for x in found.collect()} == set(expected.fetchall())

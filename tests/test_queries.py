"""Every query with SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from siteloom import model
from siteloom.plans import audit, tasks
from siteloom.sources import html_dom

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list:
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(audit.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    expected = con.sql(audit.oracle_sql()[name]).df()
    found = audit.queries()[name](spark, ROOT).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", ["page_features", "all_findings"])
def test_runs(spark, name):
    assert audit.queries()[name](spark, ROOT).count() > 0


def test_every_task_finds_something_that_sql_tells():
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    assert sum(n.startswith("task_") for n in tasks.ORACLES) == 16 == len(model.PRIORITY)
    assert all(con.sql(sql).limit(1).fetchall() for sql in tasks.ORACLES.values())


def test_markup_is_not_shuffled(spark, monkeypatch):
    """Beyond the size below which a table is spread over the cores, no exchange lies above a scan of markup."""
    monkeypatch.setattr(html_dom, "SPREAD", 0)
    pages = spark.read.parquet(f"{ROOT}/pages.parquet").selectExpr("page_id url_id", "1 project_id", "url address", "html")
    urls = pages.select("url_id", "address")
    plan = html_dom.features(urls, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rules = spark.createDataFrame([(1, 1, "h", "h", 0, "h1", True)], model.schema("extraction_rules"))
    plan = html_dom.extractions(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(url_id" not in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "url", "title", "n"]
    assert set(audit.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_patterns_are_pushed_and_columns_pruned(spark):
    plan = audit.queries()["url_rules"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Exchange" not in plan
    plan = audit.queries()["near_hash_pairs"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Lookups, changes to rows, queue states, and the registry's isolation."""

from __future__ import annotations

import pytest
from crawl_data import crawl, page
from pyspark.sql import functions as F

from siteloom import model
from siteloom.operators import base, registry
from siteloom.plans import report
from siteloom.sources import lookups
from siteloom.streaming import frontier

A = "https://www.a.com"


def test_redirect_lookups(spark):
    c = crawl(spark, [{"url": f"{A}/1"}], redirects=[(1, f"{A}/1", f"{A}/3", 301, 1), (1, f"{A}/1", f"{A}/2", 302, 0), (77, f"{A}/9", f"{A}/1", 301, 0)])
    assert {(x.source, x.to_url) for x in lookups.redirects_with_source(c).collect()} == {(f"{A}/1", f"{A}/2"), (f"{A}/1", f"{A}/3"), ("[Unknown URL ID: 77]", f"{A}/1")}
    assert {(x.url_id, x.to_url, x.status_code) for x in lookups.first_hops(c).collect()} == {(1, f"{A}/2", 302), (77, f"{A}/1", 301)}
    assert lookups.by_address(c.urls, 1, "HTTPS://www.a.com/1?x").count() == 1 == lookups.by_id(c.urls, 1).count()
    assert [x.url_id for x in lookups.in_order(c.urls, 1).collect()] == [1] and lookups.last_opened(c.projects).count() == 1


def test_links_from_pages(spark):
    body = '<a href="/2" rel="NoFollow UGC sponsored">two <img src="/i.png" alt="pic"></a><a href="mailto:x@y.z">m</a><a href="#top">t</a><a href="">none</a><script src="/s.js"></script>'
    c = crawl(spark, [{"url": f"{A}/1", "html": page(body=body, head='<link rel="stylesheet" href="/c.css">')}, {"url": f"{A}/2"}])
    ctx = base.pages(c)
    found = {(x.url, x.anchor_text, x.link_type, x.is_nofollow, x.is_ugc, x.is_sponsored) for x in lookups.links(ctx).collect()}
    assert found == {(f"{A}/2", "two pic", 0, True, True, True), (f"{A}/i.png", "pic", 1, False, False, False), (f"{A}/s.js", "", 2, False, False, False), (f"{A}/c.css", "", 3, False, False, False)}
    assert [(x.from_url_id, x.to_url_id) for x in lookups.stored_links(ctx, c.urls).collect()] == [(1, 2)]


def test_changes_and_agents(spark):
    rules = spark.createDataFrame([(1, 1, "a", "a", 0, "h1", True), (2, 1, "b", "b", 0, "h2", True)], model.schema("extraction_rules"))
    changed = lookups.upserted(rules, spark.createDataFrame([(2, 1, "b2", "b", 0, "h3", False), (3, 1, "c", "c", 0, "p", True)], rules.schema), ["rule_id"])
    assert {(x.rule_id, x.name) for x in changed.collect()} == {(1, "a"), (2, "b2"), (3, "c")}
    assert {x.rule_id for x in lookups.removed(changed, rules.where("rule_id = 1"), ["rule_id"]).collect()} == {2, 3}
    rows = spark.createDataFrame([("chrome", 1), ("random", 1), ("random", 1), ("mine/1.0", 1)], "kind string, key int").select(lookups.user_agent(F.col("kind"), F.col("key")).alias("x")).collect()
    assert "Chrome" in rows[0].x and rows[1] == rows[2] and rows[1].x in lookups.AGENTS.values() and rows[3].x == "mine/1.0"


def test_queue_states(spark):
    q = spark.createDataFrame([(1, f"{A}/{i}", 100, 1, "h", None, s) for i, s in enumerate((0, 1, 2, 3))], model.schema("frontier"))
    after = frontier.moved(q, spark.createDataFrame([(1, f"{A}/0", 1), (1, f"{A}/0", 2), (1, f"{A}/0", 1)], "project_id int, address string, state int"))
    assert {x.address[-1]: x.state for x in after.collect()} == {"0": 2, "1": 1, "2": 2, "3": 3}
    assert {x.address[-1]: x.state for x in frontier.requeued(q, failed=True).collect()} == {"0": 0, "1": 0, "2": 2, "3": 0}
    assert frontier.states(q).first().asDict() == {"project_id": 1, "queued": 1, "in_progress": 1, "done": 1, "failed": 1}


def test_admission_is_deterministic(spark):
    projects = spark.createDataFrame([(1, "s", f"{A}/", "b", 5, 10, True, None)], model.schema("projects"))
    found = spark.createDataFrame([(1, f"{A}/x", 3, False), (1, f"{A}/x", 0, False), (1, f"{A}/x", 1, True)], "project_id int, address string, from_depth int, is_resource boolean")
    (row,) = frontier.admitted(found, projects, spark.createDataFrame([], "project_id int, n_known long")).collect()
    assert (row.depth, row.priority) == (1, 99)


def test_frontier_fails_where_it_cannot_read(spark, tmp_path):
    assert not frontier.exists(spark, str(tmp_path / "none")) and frontier.exists(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, f"{A}/1", 1, 0, "h", None, 0)], model.schema("frontier"))
    rows.write.parquet(str(tmp_path / "in"))
    for number in range(2):  # a second stream over the same rows adds nothing
        frontier.start(frontier.discovered(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / f"at{number}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_report_rows_are_replaced_and_deleted(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "A", 1, "{}", None, 0, "x"), (2, 1, "B", 1, "{}", None, 1, "y"), (3, 2, "A", 2, "{}", None, 2, "z")], model.schema("report_rows"))
    report.write(rows, str(tmp_path / "r"))
    report.write(rows.where("task_key = 'A' and project_id = 1").withColumn("issue_text", F.lit("new")), str(tmp_path / "r"))
    again = spark.read.parquet(str(tmp_path / "r"))
    assert {(x.row_id, x.issue_text) for x in again.collect()} == {(1, "new"), (2, "y"), (3, "z")}
    assert {x.row_id for x in report.deleted(rows, project=1, task="A").collect()} == {2, 3} and report.deleted(rows).count() == 0
    assert [x.row_id for x in report.of_url(rows, 1).collect()] == [1, 2] and {(x.task_key, x.n) for x in report.counts(rows, "task_key").collect()} == {("A", 2), ("B", 1)}


def test_a_task_that_fails_while_it_runs_leaves_the_others(spark, tmp_path):
    c = crawl(spark, [{"url": f"{A}/1", "html": page()}])
    own = registry.default()
    own.register("Broken", lambda crawl, ctx: base.rows(ctx, "Broken", [base.rule(F.lit(True), F.raise_error(F.lit("no")), 0)]))
    found = own.run(c, ["Inventory", "TitlesMeta", "Broken"], isolated=True)
    assert {x.task_key for x in found.collect()} >= {"TitlesMeta"} and not [x for x in found.collect() if x.task_key == "Broken"]
    own.register_exporter("json", "JSON lines", ".json", lambda rows, path: rows.write.json(path))
    assert own.export("json", found, str(tmp_path / "out")).endswith("out.json") and spark.read.json(str(tmp_path / "out.json")).count() == found.count()
    with pytest.raises(ValueError, match="registered"):
        own.register_exporter("json", "again", ".json", print)
    own.register_schema(report.ReportSchema("Broken").add("Page", "Url", True))
    assert own.schemas["Broken"].primary == "Page"

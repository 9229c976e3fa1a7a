from __future__ import annotations

import gzip

import pytest
from crawl_data import crawl, page
from pyspark.sql import functions as F

from siteloom import model
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import base, graph_rules, registry
from siteloom.plans import report
from siteloom.sources import files, html_dom
from siteloom.streaming import frontier

A = "https://www.a.com"


def value(spark, f, *args):
    return spark.range(1).select(f(*(F.lit(a) for a in args)).alias("x")).first().x


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTP://User@Example.COM:80/Path/?q=1#f", "http://example.com/path/"), ("https://a.com:443", "https://a.com/"), ("https://a.com:8443/x", "https://a.com:8443/x"), ("not a url", "not a url"), ("/relative", "/relative"),
])
def test_normalize(spark, url, expected):
    assert value(spark, U.normalize, url) == expected
    assert value(spark, U.normalize, expected) == expected


@pytest.mark.parametrize(("href", "expected"), [("/x", "http://a.com/x"), ("x", "http://a.com/d/x"), ("//b.com/y", "https://b.com/y"), ("?p=2", "http://a.com/d/e?p=2"), ("#f", "http://a.com/d/e?q=1#f"), ("https://c.com", "https://c.com")])
def test_resolve(spark, href, expected):
    assert value(spark, U.resolve, "http://a.com/d/e?q=1", href) == expected


def test_hosts_and_variants(spark):
    assert not value(spark, U.is_external, "https://www.a.com/", "http://a.com/x") and value(spark, U.is_external, "https://www.a.com/", "http://b.com") and not value(spark, U.is_external, "https://a.com", "/x")
    assert value(spark, U.variants, "https://www.a.com/x") == ["http://a.com/", "http://www.a.com/", "https://a.com/"]
    assert value(spark, U.extension, "http://a.com/x.tar.gz?y.z") == ".gz" and value(spark, U.is_static, "http://a.com/x.css") and not value(spark, U.is_static, "http://a.com/x.html")


def test_text_functions(spark):
    assert value(spark, X.sha256, "abc").startswith("BA7816BF") and value(spark, X.pixel_width, "IiA b") == 12 + 4 + 12 + 4 + 8
    assert value(spark, X.utf16_length, "a😀") == 3 and value(spark, X.preview, "x" * 130) == "x" * 120 + "..." and value(spark, X.unescape, "a &amp; b") == "a & b"
    assert X.fingerprint(None) == 0 == X.fingerprint("the and for") and X.fingerprint("harbour boats") != X.fingerprint("mountain trains")
    assert value(spark, X.jaccard, "red green blue", "green blue cyan") == 0.5 and value(spark, X.jaccard, "", "x") == 0
    assert value(spark, X.sheet_name, "a/b:c" + "x" * 40) == "a_b_c" + "x" * 26


def test_parser_tolerates_tag_soup():
    f = html_dom.parse("http://a.com/d/", '<base href="/b/"><p>One<b>two<a href=x>l<img alt=pic src=i.png><a href="y">m</p><script>if (a<b) {"</p>"}</script></div></div><h2>Head &eacute;<TABLE><a name=spot></a>')
    assert [(a["url"], a["text"]) for a in f["anchors"]] == [("http://a.com/b/x", "lpic"), ("http://a.com/b/y", "mHead é")] and f["ids"] == ["spot"] and f["images"][0]["url"] == "http://a.com/b/i.png"
    assert html_dom.parse("", "")["title"] is None and html_dom.parse("u", "<")["anchors"] == []


def test_selectors():
    html = '<div class="a b"><p>x</p><span><p id=q data-k="v1">y</p></span></div><p>z</p>'
    assert html_dom.selected(html, "div.a > p", 0) == ["x"] and html_dom.selected(html, "div p", 0) == ["x", "y"] and html_dom.selected(html, "p[data-k^=v], #q", 0) == ["y"]
    assert html_dom.selected(html, "/div/span/p", 1) == ["y"] and html_dom.selected(html, "//p[2]", 1) == ["y"] and html_dom.selected(html, "//p[contains(@data-k,'1')] | //div/p", 1) == ["x", "y"]
    for bad, kind in (("p:first-child", 0), ("p[last()]", 1)):
        with pytest.raises(ValueError):
            html_dom.selected(html, bad, kind)


def test_robots(spark):
    text = "User-agent: *\nDisallow: /x\nAllow: /x/y # open\nCrawl-delay: 30\n\nUser-agent: Bot\nDisallow: /z\nCrawl-delay: 2\nSitemap: https://a.com/s.xml"
    rules, delays, maps = files.robots_rules(spark.createDataFrame([("a.com", text)], model.schema("robots_txt")))
    urls = spark.createDataFrame([("https://a.com/x",), ("https://a.com/x/y/1",), ("https://a.com/z",), ("https://a.com/",), ("https://b.com/x",)], "address string")
    assert {x.address: x.allowed for x in files.allowed(urls, rules, "MyBot").collect()} == {"https://a.com/x": False, "https://a.com/x/y/1": True, "https://a.com/z": False, "https://a.com/": True, "https://b.com/x": True}
    assert [x.delay for x in files.crawl_delay(delays, "bot").collect()] == [2.0] and [x.delay for x in files.crawl_delay(delays, "other").collect()] == [10.0] and maps.first().sitemap == "https://a.com/s.xml"


def test_sitemap_parsing_and_discovery(spark):
    index = f"<sitemapindex><sitemap><loc>{A}/s1.xml</loc></sitemap><sitemap><loc>{A}/i.xml</loc></sitemap></sitemapindex>"
    assert files.parse_sitemap("u", gzip.compress(b"<urlset><url><loc>http://a</loc></url></urlset>"))["entries"][0]["loc"] == "http://a"
    assert files.parse_sitemap("u", b"\x1f\x8bbad")["kind"] == "gzip" and files.parse_sitemap("u", None)["kind"] == "empty" and files.parse_sitemap("u", "<a")["kind"] == "broken"
    parsed = files.sitemaps(spark.createDataFrame([(f"{A}/i.xml", index), (f"{A}/s1.xml", f"<urlset><url><loc>{A}/1</loc></url><url><loc>bad</loc></url></urlset>"), (f"{A}/other.xml", f"<urlset><url><loc>{A}/2</loc></url></urlset>")], model.schema("sitemaps")))
    assert [x.loc for x in files.discover(parsed, spark.createDataFrame([(f"{A}/i.xml",)], "url string")).collect()] == [f"{A}/1"]


def test_url_list(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Url,Priority\nhttps://a.com/1,5\nhttps://a.com/1,\n,3\nnonsense,1\nhttps://a.com/2\nhttps://a.com/known,1\n")
    queue, counts = files.url_list(spark, str(tmp_path / "l.csv"), spark.createDataFrame([("https://a.com/known",)], "address string"))
    assert {(x.address, x.priority) for x in queue.collect()} == {("https://a.com/1", 1000), ("https://a.com/2", 1000)}
    assert counts.first().asDict() == {"imported": 2, "skipped": 2, "invalid": 1}


def test_upsert_and_headers(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, t int")
    assert {(x.k, x.v) for x in files.latest(rows, ["k"], F.col("t")).collect()} == {(1, "b"), (2, "c")}
    heads = spark.createDataFrame([(1, "X", "first", 0), (1, "x", "second", 1), (1, "Set-Cookie", "a", 2), (1, "set-cookie", "b", 3)], model.schema("headers"))
    assert files.header_map(heads).first().headers == {"x": "first", "set-cookie": "a\nb"}


def test_report_layer(spark, tmp_path):
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page(title="" if i else "A fine long title for the home page"), "depth": i} for i in range(3)])
    found = registry.default().run(c, ["TitlesMeta", "Inventory"])
    rows = report.stored(found)
    q = report.ReportQuery(rows, c.urls).for_task("TitlesMeta")
    ordered = [x.severity for x in q.ordered().collect()]
    assert ordered == sorted(ordered) and q.count() == len(ordered) and q.page(-1, 0).count() == min(100, len(ordered)) and q.page(1, 2).count() == 2
    assert q.search("  Missing Title ").count() == 2 and q.search("missing title").count() == 0 and q.search(f"{A}/1").severity(0).count() == 1
    assert {x.issue_text for x in q.severity(0).sort("issue", True).ordered().collect()} == {"Missing Title", "Duplicate Title (2 pages)"} or q.severity(0).count() >= 2
    assert report.export_findings(found, str(tmp_path)) == ["Inventory", "TitlesMeta", "Summary"] if found.where("task_key = 'Inventory'").count() else True
    ctx = base.pages(c)
    assert report.url_sheet(ctx).count() == 3 and report.overview(ctx, "FINE LONG").count() == 1 and report.properties(ctx).where("key = 'title'").count() == 3
    report.export_sitemap(ctx, str(tmp_path / "map"))
    text = "".join(x.value + "\n" for x in spark.read.text(str(tmp_path / "map"), wholetext=True).collect())
    assert files.parse_sitemap("m", text)["kind"] == "urlset" and len(files.parse_sitemap("m", text)["entries"]) == 3


def test_issue_text_and_severity(spark):
    for row, expected in (('{"Issue":" ","Message":"m"}', "m"), ('{"Explanation":"' + "e" * 600 + '"}', "e" * 512), ("{}", None)):
        assert value(spark, report.issue_text, row) == expected
    assert [value(spark, report.severity_of, x) for x in ("Error", "1", "INFO", "9", "x")] == [0, 1, 2, None, None]


def test_report_schemas():
    s = report.ReportSchema("T").add("Page", "Url", primary=True).add("N", "Integer")
    assert s.struct().simpleString() == "struct<Severity:string,Page:string,N:bigint>" and s.primary == "Page"
    for bad in ("page", "Severity"):
        with pytest.raises(ValueError):
            s.add(bad)
    assert report.synced({"T": s}, [s])["T"].version == 1 and report.synced({"T": s}, [s.add("More")])["T"].version == 2


def test_breadth_first_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    assert {(x.address, x.depth) for x in graph_rules.reached(spark.createDataFrame([("a",)], "address string"), edges, 2, 10).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph_rules.reached(spark.createDataFrame([("a",)], "address string"), edges, 9, 3).count() == 3


def test_stream_merges_once(spark, tmp_path):
    rows = lambda *urls: spark.createDataFrame([(1, u, p, 0, "h", None, 0) for u, p in urls], model.schema("frontier"))
    rows(("https://a.com/1", 1), ("https://A.com/1", 5), ("https://a.com/2", 1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = frontier.discovered(spark, str(tmp_path / "in"))
        frontier.start(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(60)
    rows(("https://a.com/2", 9), ("https://a.com/3", 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frontier.start(frontier.discovered(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(60)
    table = spark.read.parquet(str(tmp_path / "table"))
    assert sorted((x.address, x.priority) for x in table.collect()) == [("https://A.com/1", 5), ("https://a.com/2", 1), ("https://a.com/3", 2)]
    assert [x.address for x in frontier.following(table, 2).collect()] == ["https://A.com/1", "https://a.com/3"]


def test_admission(spark):
    projects = spark.createDataFrame([(1, "s", "https://a.com/", "b", 2, 3, True, None)], model.schema("projects"))
    found = spark.createDataFrame([(1, "https://a.com/p", 1, False), (1, "https://a.com/deep", 2, False), (1, "https://a.com/i.png", 2, True), (1, "https://b.com/", 0, False)], "project_id int, address string, from_depth int, is_resource boolean")
    known = spark.createDataFrame([(1, 1)], "project_id int, n_known long")
    rows = {x.address: (x.depth, x.priority) for x in frontier.admitted(found, projects, known).collect()}
    assert rows == {"https://a.com/p": (2, 98), "https://a.com/i.png": (2, 98)}

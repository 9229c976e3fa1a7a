from __future__ import annotations

import pytest
from crawl_data import LONG, crawl, issues, page
from pyspark.sql import functions as F

from siteloom.operators import base, dup_rules, graph_rules, page_rules, registry, site_rules

A = "https://www.a.com"


def run(task, c, **more):
    return issues(task(c, base.pages(c), **more))


def has(found: dict, i: int | None, *starts: str) -> bool:
    return all(any(x.startswith(s) for x in found.get(i, ())) for s in starts)


def lacks(found: dict, i: int | None, *starts: str) -> bool:
    return not any(x.startswith(s) for x in found.get(i, ()) for s in starts)


def test_inventory(spark):
    third = "".join(f'<script src="https://cdn{i}.other.net/x.js"></script>' for i in range(11))
    c = crawl(spark, [
        {"url": f"{A}/" + "a" * 62, "html": page(body="x" * 899, h1="")}, {"url": f"{A}/" + "a" * 90, "html": page(body="x" * 900, h1="")}, {"url": f"{A}/Up_per?a=1&b=2&c=3&page=4", "html": page(body="x" * 1799, h1="")},
        {"url": f"{A}/s?PHPSESSID=1&sid=2", "html": page(head=third)}, {"url": f"{A}/é", "html": page()}, {"url": f"{A}/" + "a" * 57, "html": page()},
    ])
    f = run(page_rules.inventory, c)
    assert has(f, 1, "URL length > 75 characters (excluding query)", "Very short content (<900 characters)") and has(f, 2, "URL length > 100 characters (excluding query)", "Limited content length (<1800 characters)")
    assert has(f, 3, "Uppercase", "Too many query parameters (4)", "Pagination", "Underscore detected in path", "Limited content length (<1800 characters)")
    assert has(f, 4, "PHPSESSID", "More than 10 third-party domains (11)") and lacks(f, 4, "SID (PHP)") and has(f, 5, "Special characters")
    assert lacks(f, 6, "URL length", "Special", "Limited", "Very short")


def test_security(spark):
    good = [("Strict-Transport-Security", "max-age=31536000"), ("Content-Security-Policy", "x"), ("X-Content-Type-Options", "NoSniff"), ("X-Frame-Options", "DENY"), ("Referrer-Policy", "x"), ("Set-Cookie", "a=1; Secure; HttpOnly")]
    c = crawl(spark, [{"url": f"{A}/1", "html": page(body=LONG + '<img src="http://x.com/i.png"><img src="http://x.com/j.png"><script src="http://x.com/s.js"></script>')}, {"url": f"{A}/2", "html": page()}, {"url": "http://www.a.com/3", "html": page()}], headers=[(2, *h) for h in good] + [(1, "strict-transport-security", "max-age=100"), (1, "set-cookie", "a=1; Secure"), (1, "set-cookie", "b=2,c=3")])
    rows = page_rules.security(c, base.pages(c)).collect()
    f = {}
    for x in rows:
        f.setdefault(x.url_id, {})[x.issue] = x.fields
    assert f[1]["Mixed Content (3 HTTP resources)"]["Details"] == "2 Image(s), 1 Script(s)"
    assert f[1]["Missing/Weak Security Headers"]["Details"] == "4 missing, 1 weak" and f[1]["Insecure Cookies"]["Details"] == "3 cookie(s)"
    assert 2 not in f and "HTTP Instead of HTTPS" in f[3]


def test_robots(spark):
    c = crawl(spark, [{"url": f"{A}/", "html": page(), "depth": 0}, {"url": f"{A}/1", "html": page(head='<meta name="robots" content="none">')}, {"url": f"{A}/2", "html": page(head='<meta name="robots" content="noindex">'), "depth": 4}, {"url": f"{A}/4", "html": page(head='<meta name="robots" content="noindex">')}], headers=[(4, "X-Robots-Tag", "noarchive"), (2, "X-Robots-Tag", "noarchive, max-snippet:0, max-image-preview:none, max-video-preview:5, googlebot-news: x, unavailable_after: y, nosnippet, noimageindex, indexifembedded")], robots=())
    f = run(page_rules.robots, c)
    assert has(f, 1, "No robots.txt Found") and lacks(f, 2, "No robots.txt")
    assert has(f, 2, "Noindex", "Nofollow", "X-Robots-Tag", "Important Page Not Indexable (Depth 1)", "Noarchive", "Nosnippet", "Noimageindex", "Unavailable", "Indexifembedded", "Max-Snippet: 0", "Max-Image-Preview: none", "Max-Video-Preview: 5", "Googlebot-News")
    assert has(f, 4, "Conflicting", "Noarchive") and has(f, 3, "Noindex") and lacks(f, 3, "Important", "Nofollow", "Conflicting")
    assert page_rules.robots(crawl(spark, [{"url": f"{A}/", "html": page(), "depth": 0}]), base.pages(crawl(spark, [{"url": f"{A}/", "html": page(), "depth": 0}]))).count() == 0


@pytest.mark.parametrize(("n", "expected"), [(29, "Title Too Short"), (30, None), (60, None), (61, "Title Long"), (70, "Title Long"), (71, "Title Too Long")])
def test_title_lengths(spark, n, expected):
    f = run(page_rules.titles, crawl(spark, [{"url": f"{A}/1", "html": page(title="i" * n)}]))
    assert {x for x in f[1] if x.startswith(("Title Too", "Title Long"))} == ({next(x for x in f[1] if x.startswith(expected))} if expected else set())


def test_titles(spark):
    c = crawl(spark, [
        {"url": f"{A}/1", "html": page(title="", meta=False, lang="", h1="")}, {"url": f"{A}/2", "html": page(title="W" * 51, head='<meta name="keywords" content="x"><meta charset="latin1"><meta name="viewport" content="y"><meta property="og:title" content="t"><h3>x</h3>')},
        {"url": f"{A}/3", "html": page(title="Same | title of pages three and four", h1="same | title of pages three and four")}, {"url": f"{A}/4", "html": page(title="same | title of PAGES three and four", body=LONG + "<h1>x</h1><h2>y</h2><h4>z</h4>")},
    ])
    f = run(page_rules.titles, c)
    assert has(f, 1, "Missing Title", "Missing Meta Description", "Missing Viewport", "Missing Charset", "Missing Lang", "Missing Open Graph", "Missing Twitter", "Empty H1") and lacks(f, 1, "Title Too Short")
    assert has(f, 2, "Title Pixel Width Exceeded (~612px)", "Meta Keywords", "Multiple Charset Declarations (2)", "Multiple Viewport Declarations (2)", "Incomplete Open Graph (1/4)", "Title Lacks Visual", "Heading Hierarchy Skips H2", "H1 and Title Unrelated", "Duplicate Meta Description (3 pages)")
    assert has(f, 3, "Identical H1", "Duplicate Title (2 pages)") and has(f, 4, "Duplicate Title (2 pages)", "Multiple H1 Tags (2)", "Heading Hierarchy Skips H3")
    assert lacks(f, 3, "Title Lacks", "Description Lacks", "Missing Lang", "Non-UTF8")


def test_duplicate_titles_of_redirects(spark):
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page(title="The same long title on each of them")} for i in (1, 2, 3)], redirects=[(1, f"{A}/1", f"{A}/2", 301, 0)])
    f = run(page_rules.titles, c)
    assert has(f, 1, "Duplicate Title (2 pages)") and has(f, 3, "Duplicate Title (3 pages)") and lacks(f, 1, "Duplicate Title (Temp")
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page(title="The same long title on each of them")} for i in (1, 2)], redirects=[(1, f"{A}/1", f"{A}/2", 302, 0)])
    assert has(run(page_rules.titles, c), 2, "Duplicate Title (Temporary Redirects)") and lacks(run(page_rules.titles, c), 2, "Duplicate Title (2")


def test_images(spark):
    pictures = '<img><img src="/a.jpg" width="500" height="300"><img src="https://other.com/icon.webp" alt="abc" width=1 height=1 loading=lazy><img src="/v.svg" width="10" height="10" alt="image of a boat" title="Image of a boat">' + f'<img src="/b.webp" alt="{"y" * 126}" width=1 height=1><img src="data:image/png;base64,{"A" * 20000}"><img src="/a.jpg" width="500" height="300">'
    f = run(page_rules.images, crawl(spark, [{"url": f"{A}/1", "html": page(body=pictures)}]))
    assert has(f, 1, "Missing Image Source", "Missing Lazy", "Missing Responsive", "Legacy", "External Image", "SVG with", "Missing Alt", "Alt Text Too Short", "Alt Text Too Long", "Potentially Decorative", "Redundant Title", "Alt Text Bad", "Large Data URI (14KB)")
    c = crawl(spark, [{"url": f"{A}/1", "html": page(body=pictures)}])
    assert page_rules.images(c, base.pages(c)).where("issue = 'Legacy Image Format'").count() == 1


def test_crawl_budget(spark):
    pages = [{"url": f"{A}/{i}", "html": page(), "status": 503 if i < 4 else 200} for i in range(50)] + [{"url": f"{A}/n", "html": page(title="Page not found here", body="x")}, {"url": f"{A}/m", "html": page(body="coming soon " + LONG)}]
    f = run(page_rules.crawl_budget, crawl(spark, pages))
    assert has(f, 1, "Server Error (HTTP 503)") and has(f, None, "High Server Error Rate (7%)") and has(f, 51, "Soft 404 (high") and has(f, 52, "Soft 404 (medium") and lacks(f, 30, "Soft")


def test_hreflang(spark):
    alt = lambda *codes: "".join(f'<link rel="alternate" hreflang="{c}" href="{u}">' for c, u in codes)
    c = crawl(spark, [
        {"url": f"{A}/1", "html": page(head=alt(("en-US", f"{A}/1"), ("de", f"{A}/2"), ("de", f"{A}/2"), ("xx", f"{A}/3"), ("fr-fr", f"{A}/4")))},
        {"url": f"{A}/2", "html": page(head=alt(("de", f"{A}/2"), ("x-default", f"{A}/9")))}, {"url": f"{A}/5", "html": page(head=alt(("en", f"{A}/6")) + f'<link rel=canonical href="{A}/7">')},
    ], headers=[(3, "Link", f'<{A}/8>; rel="alternate"; hreflang="fr"')])
    f = run(page_rules.hreflang, c)
    assert has(f, 1, "Invalid Hreflang Syntax (2 tags)", "Duplicate Hreflang Codes", "Missing x-default", "Missing Bidirectional Links (1 targets)") and lacks(f, 1, "Missing Self")
    assert lacks(f, 2, "Invalid", "Missing", "Duplicate") and has(f, 3, "Missing Self-Referencing", "HTML/HTTP Hreflang Mismatch", "Hreflang/Canonical Conflict")
    assert has(run(page_rules.hreflang, c, compat=True), 1, "Invalid Hreflang Syntax (3 tags)")


def test_redirects(spark):
    moved = lambda a, b, s=301: {"url": a, "status": s, "target": b, "html": None}
    c = crawl(spark, [
        moved(f"{A}/1", "http://www.a.com/1x", 302), moved(f"{A}/2", None), moved(f"{A}/3", f"{A}/3/"), {"url": f"{A}/4", "html": page(head='<meta http-equiv="refresh" content="5; url=/x">', body=LONG + '<script>window.location.href = "/next";</script>')},
        moved(f"{A}/5", f"{A}/6"), moved(f"{A}/6", f"{A}/7"), moved(f"{A}/7", f"{A}/8"), {"url": f"{A}/8", "html": page()}, moved(f"{A}/9", f"{A}/10"), moved(f"{A}/10", f"{A}/9"), moved(f"{A}/11", "https://a.com/"), {"url": f"{A}/12", "status": 301, "loop": True}, moved(f"{A}/13", f"{A}/14"), {"url": f"{A}/14", "status": 404},
    ], headers=[(1, "Cache-Control", "max-age=172800")])
    f = run(graph_rules.redirects, c)
    assert has(f, 1, "Temporary redirect detected", "Redirect downgrades", "Temporary redirect cached for 2 days", "Temporary Redirect (302)") and has(f, 2, "Redirect is missing") and has(f, 3, "Trailing-slash")
    assert has(f, 4, "Meta refresh redirect (5s", "JavaScript-based") and has(f, 5, "Redirect Chain (3 hops)", "Redirect target itself") and has(f, 6, "Redirect Chain (2 hops)") and lacks(f, 7, "Redirect Chain")
    assert has(f, 9, "Redirect Loop") and has(f, 11, "Redirect from www") and f[12] == {"Infinite redirect loop"} and has(f, 13, "Redirect target returns HTTP 404")


def test_canonical(spark):
    to = lambda u: f'<link rel="canonical" href="{u}">'
    c = crawl(spark, [
        {"url": f"{A}/1", "html": page()}, {"url": f"{A}/2", "html": page(head=to(f"{A}/3") + to(f"{A}/3"))}, {"url": f"{A}/3", "html": page(head=to(f"{A}/4"))}, {"url": f"{A}/4", "html": page(head=to(f"{A}/4/"))},
        {"url": f"{A}/5", "html": page(head=to("https://b.org/") + '<meta name="robots" content="noindex">')}, {"url": f"{A}/6?page=2", "html": page(head=to(f"{A}/6"))}, {"url": f"{A}/7", "html": page(head=to(f"{A}/8"))}, {"url": f"{A}/8", "html": page(head=to(f"{A}/7"))}, {"url": f"{A}/9", "html": page(head=to(f"{A}/10"))}, {"url": f"{A}/10", "status": 404},
    ], headers=[(4, "Link", f"<{A}/q>; rel=canonical")])
    f = run(graph_rules.canonical, c)
    assert has(f, 1, "Missing Canonical") and has(f, 2, "Multiple", "Canonical to Other", "Canonical Chain") and lacks(f, 2, "Canonical Loop") and lacks(f, 4, "Canonical to Other", "Missing") and has(f, 4, "Canonical HTML/HTTP")
    assert has(f, 5, "Cross-Domain", "Canonical + Noindex") and has(f, 6, "Pagination Canonical") and has(f, 7, "Canonical Loop") and has(f, 8, "Canonical Loop") and has(f, 9, "Canonical Target Error (HTTP 404)")


def test_internal_linking_and_graph(spark):
    a = lambda u, t="here": f'<a href="{u}">{t}</a>'
    c = crawl(spark, [{"url": f"{A}/", "html": page(body=a("/1") + a("/1", "Read more") + a("/1", "boats") + a("/2"), h1=""), "depth": 0}, {"url": f"{A}/1", "html": page()}, {"url": f"{A}/2", "html": page(body=a("/")), "depth": 2}, {"url": f"{A}/3", "html": page(), "depth": 2}], links=[(1, 1, 2, "boats", 0, None, False, False, False, None), (1, 1, 9, " ", 1, None, False, False, False, None)])
    f = run(graph_rules.internal_linking, c)
    assert has(f, 2, "No Outlinks", "Generic Anchor") and has(f, 3, "Few Outlinks", "Generic Anchor") and lacks(f, 3, "Orphan") and has(f, 4, "Orphan Page") and lacks(f, 1, "Orphan", "Few", "No")
    rows = {(x.issue, x.fields["ToURL"]) for x in graph_rules.link_graph(c, base.pages(c)).collect()}
    assert rows == {("Internal hyperlink with anchor text", f"{A}/1"), ("Internal image link without anchor text", "Unknown")}
    assert {x.url_id for x in graph_rules.orphans(base.pages(c)).collect()} == {4}


def test_broken_links(spark):
    body = '<a id="top"></a><a href="#top">t</a><a href="#gone">g</a><a href="/ok">o</a><a href="/404">x</a><a href="/404">x</a><a href="/301" rel="nofollow">r</a><a href="/never">n</a><a href="https://o.org/a">e</a><a href="https://o.org/slow">s</a><a href="mailto:x">m</a><img src="/403.png">'
    c = crawl(spark, [{"url": f"{A}/1", "html": page(body=body)}, {"url": f"{A}/ok", "html": page()}, {"url": f"{A}/404", "status": 404}, {"url": f"{A}/301", "status": 301}, {"url": f"{A}/403.png", "status": 403}], external=[("https://o.org/a", "bot", 0, 0.1, "x"), ("https://o.org/slow", "bot", 200, 6.0, None)])
    found = graph_rules.broken_links(c, base.pages(c)).where("url_id = 1").collect()
    assert {(x.issue, x.severity) for x in found} == {("Broken Anchor Link", 1), ("Broken Hyperlink", 0), ("Link Points to Redirect", 2), ("Nofollow on Internal Link", 1), ("Link Not Crawled", 1), ("Connection Failed (Hyperlink)", 1), ("Slow External Link", 2), ("Forbidden Link", 2)}
    assert next(x.fields["Occurrences"] for x in found if x.issue == "Broken Hyperlink") == "2"


def test_duplicates(spark):
    words = [f"word{i}x" for i in range(400)]
    near = " ".join([*words[:399], "other"])
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page(body="<p>" + t)} for i, t in enumerate([" ".join(words), " ".join(words), near, "quite different text " * 30], 1)] + [{"url": f"{A}/b", "html": page(body="<nav>" + "x " * 200 + "</nav>y", h1="")}], probes=[(1, "http://a.com/", 301, f"{A}/", None), (1, "http://www.a.com/", 200, None, None), (1, "https://a.com/", None, None, "timeout")])
    f = run(dup_rules.duplicates, c)
    assert has(f, 1, "Exact Duplicate (2 pages)") and has(f, 2, "Exact Duplicate (2 pages)") and lacks(f, 3, "Exact") and lacks(f, 4, "Exact", "Near") and has(f, 5, "High Boilerplate Ratio")
    assert has(f, None, "Domain Variant Correct", "Domain Variant Duplicate Content", "Domain Variant Timeout")
    early = run(dup_rules.duplicates, c, arrival=True)
    assert lacks(early, 1, "Exact") and has(early, 2, "Exact Duplicate (2 pages)")


def test_fingerprints_take_no_more_memory_in_large_batches(spark, monkeypatch):
    """A batch's texts are fingerprinted in runs, and batches are bounded where pages are parsed."""
    import pandas as pd

    from siteloom.functions import text as X
    from siteloom.sources import html_dom

    assert [len(x) for x in X.runs(["a" * 4, None, "b" * 6, "c" * 30, "", "d"], 10)] == [3, 1, 2] and list(X.runs([])) == []
    texts, sizes, whole = [f"word{i} other{i % 7} words " * 40 for i in range(3000)] + [None, ""], [], X.fingerprints
    monkeypatch.setattr(X, "fingerprints", lambda own: sizes.append(sum(len(t or "") for t in own)) or whole(own))
    found = pd.concat(X.simhash.func(iter([pd.Series(texts), pd.Series([], dtype=object)])))
    assert found.tolist() == whole(texts).tolist() and max(sizes) <= X.RUN < sum(sizes)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    spark.conf.set(bound, str(256 << 20))
    c = crawl(spark, [{"url": f"{A}/1", "html": page()}])
    html_dom.features(c.urls, c.page_html)
    assert int(spark.conf.get(bound).rstrip("b")) == 4 << 20
    spark.conf.set(bound, before)


def test_copies_on_arrival_parse_pages_once(spark, monkeypatch):
    from siteloom.sources import html_dom

    read, parse = spark.sparkContext.accumulator(0), html_dom.features

    def counted(urls, page_html):
        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        found = parse(urls, page_html)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(html_dom, "features", counted)
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page()} for i in range(4)])
    early = issues(dup_rules.exact_on_arrival(c, base.pages(c)))
    assert read.value == 4 and lacks(early, 1, "Exact") and has(early, 4, "Exact Duplicate (4 pages)")
    issues(dup_rules.duplicates(c, base.pages(c)))
    assert read.value == 8


def test_near_pairs_match_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    base_hashes = [r.getrandbits(64) for _ in range(30)]
    hashes = sorted({h ^ sum(1 << b for b in r.sample(range(64), k)) for h in base_hashes for k in (0, 1, 2, 3, 4)})
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    found = {(x.a, x.b) for x in dup_rules.near_pairs(spark.createDataFrame([(1, h) for h in signed], "project_id int, hash long")).collect()}
    expected = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if 1 <= ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert found == expected and expected


def test_near_pairs_of_crowded_bands_are_not_compared(spark, monkeypatch):
    """Hashes that leave bits unused all share a band: no two of them are compared, they meet in keys."""
    import itertools

    hashes = sorted({(i * 2654435761 % 2**32) // 4096 * 64 for i in range(3000)} | {-1, -2, -4, 1 << 62, (1 << 62) + 3})
    near = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a, b in itertools.combinations(hashes, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    expected = sorted((k, a, b, d) for (a, b), d in near.items() for k in (1, 2))
    rows = lambda own: spark.createDataFrame([(k, h) for h in own for k in (1, 2)], "project_id int, hash long")
    assert sorted(map(tuple, dup_rules.near_pairs(rows(hashes)).collect())) == expected and near
    calls, own = spark.sparkContext.accumulator(0), [h for h in hashes if 0 <= h < 1 << 43]

    @F.udf("int")
    def hamming(a, b):
        calls.add(1)
        return ((a ^ b) & (2**64 - 1)).bit_count()

    monkeypatch.setattr(dup_rules.X, "hamming", hamming)
    assert sorted(map(tuple, dup_rules.near_pairs(rows(own)).collect())) == [x for x in expected if x[1] in set(own) and x[2] in set(own)]
    assert calls.value == 0
    monkeypatch.setattr(dup_rules, "CROWD", 3)  # pairs of a crowded and a quiet hash, and of two crowded ones in a quiet bucket
    assert sorted(map(tuple, dup_rules.near_pairs(rows(hashes[::3])).collect())) == [x for x in expected if x[1] in set(hashes[::3]) and x[2] in set(hashes[::3])]


def test_sitemaps(spark):
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    entry = lambda u, m="2020-01-01", p="1.0": f"<url><loc>{u}</loc><lastmod>{m}</lastmod><priority>{p}</priority></url>"
    maps = [(f"{A}/sitemap.xml", head + "".join(entry(f"{A}/{i}") for i in range(1, 13)) + entry("bad") + entry(f"{A}/x", "2999-01-01", "7") + "</urlset>"), (f"{A}/sitemap-i.xml", f"<sitemapindex><sitemap><loc>{A}/sitemap.xml</loc></sitemap></sitemapindex>"), (f"{A}/sitemap-b.xml", "<urlset><url>"), (f"{A}/sitemap-e.xml", head + "</urlset>")]
    plain = {"html": None, "type": "application/xml"}
    c = crawl(spark, [{"url": u, **plain} for u, _ in maps] + [{"url": f"{A}/sitemap-n.xml", **plain, "status": 404}, {"url": f"{A}/1", "html": page(), "status": 200}, {"url": f"{A}/2", "status": 404}, {"url": f"{A}/3", "status": 500}, {"url": f"{A}/4", "status": 301}, {"url": f"{A}/unlisted", "html": page()}], sitemaps=maps)
    f = run(site_rules.sitemap, c, now="2025-01-01")
    assert has(f, 1, "Sitemap Parsed (14 URLs)", "Invalid URLs (1)", "Future Lastmod Dates (1)", "Outdated URLs (13 > 2 years old)", "Invalid Priority Values (1)", "Sitemap Contains 404s (1 URLs)", "Sitemap Contains 5xx Errors (1 URLs)", "Sitemap Contains Redirects (1 URLs)", "All Priority 1.0 (Defeats Purpose)")
    assert has(f, 2, "Sitemap Index (1 sitemaps)", "Invalid Sitemap XML (Missing Namespace)") and has(f, 3, "Sitemap Parse Error") and has(f, 4, "Empty Sitemap") and has(f, 5, "Sitemap Not Found")
    assert has(f, None, "Orphan URLs in Sitemap (1)", "URLs Missing from Sitemap (1)")


def test_structured_data(spark):
    import json

    ld = lambda *x: "".join(f'<script type="application/ld+json">{json.dumps(b) if not isinstance(b, str) else b}</script>' for b in x)
    business = lambda name: {"@type": "LocalBusiness", "name": name, "url": "u", "telephone": "555", "address": "x", "openingHours": "y"}
    c = crawl(spark, [
        {"url": f"{A}/blog/1", "html": page(head=ld({"@type": "Article", "headline": "x"}, "{bad", [{"@type": "Product", "name": "n", "image": "i", "offers": {"price": "x"}}]))},
        {"url": f"{A}/product/2", "html": page()}, {"url": f"{A}/contact/", "html": page(body=LONG + "call +1 (555) 123-4567")}, {"url": f"{A}/4", "html": page(head=ld(business("One"), {"@type": "FAQPage", "mainEntity": [{"acceptedAnswer": {"text": "short"}}, {}]}, {"@type": "BreadcrumbList", "itemListElement": [1, 2]}))},
        {"url": f"{A}/5", "html": page(head=ld(business("Two"), {"@type": "HowTo"}, {"@type": "VideoObject", "name": "x"}, {"@type": "Review", "reviewRating": {"ratingValue": 9}}), body=LONG + '<div itemscope itemtype="http://schema.org/Thing"></div>')},
    ])
    f = run(site_rules.structured_data, c)
    assert has(f, 1, "Incomplete Article Schema", "JSON Syntax Error", "Product Recommendations", "JSON-LD Found (2 schemas)", "Missing Author Markup") and has(f, 2, "Missing Structured Data") and has(f, 3, "Missing Address") and lacks(f, 3, "Missing Phone")
    assert has(f, 4, "FAQ Missing Answers (1)", "FAQ Short Answers (1)", "Breadcrumb Found (2 levels)", "LocalBusiness Recommendations", "NAP Inconsistency") and has(f, 5, "Missing step", "Incomplete Video Schema", "Incomplete Review Schema", "Review Recommendations", "Microdata Found (1 items)")


def test_extraction_and_pivot(spark):
    rules = [(1, 1, "Price", "price", 0, "span.price", True), (2, 1, "Links", "l", 1, "//a[@rel='x']", True), (3, 1, "Code", "c", 2, r"sku-(\d+)", True), (4, 1, "Off", "o", 0, "p", False), (5, 1, "Bad", "b", 2, "(", True)]
    c = crawl(spark, [{"url": f"{A}/1", "html": page(body='<span class="big price"> 5 </span><span class=price>6</span><a rel="x">L</a> SKU-77')}, {"url": f"{A}/2", "html": page()}], rules=rules)
    found = site_rules.extraction(c, base.pages(c))
    rows = {(x.url_id, x.issue): x.fields for x in found.collect()}
    assert rows[1, "Price"]["ExtractedValue"] == "5\n6" and rows[1, "Price"]["Count"] == "2" and rows[1, "Links"]["ExtractedValue"] == "L" and rows[1, "Code"]["ExtractedValue"] == "77"
    assert (2, "Extraction failed: Bad") in rows and not any(k[1] == "Off" for k in rows)
    wide = site_rules.pivot(found, c.extraction_rules)
    assert wide.columns[:2] == ["Page", "Severity"] and wide.columns[2:] == ["Bad", "Code", "Links", "Price"]


def test_all_tasks_run_together_and_a_broken_one_does_not_stop_them(spark):
    c = crawl(spark, [{"url": f"{A}/{i}", "html": page(title=f"Title number {i} of the pages here"), "depth": i} for i in range(4)])
    every = registry.default()
    every.register("Broken", lambda crawl, ctx: 1 / 0, 1)
    found = every.run(c)
    assert found.columns == base.ROW and found.count() > 10
    assert every.ordered()[0][0] == "Broken" and every.ordered()[-1][0] == "LinkGraph"
    shaped = base.shaped(found, "TitlesMeta")
    assert shaped.columns == ["project_id", "url_id", "Severity", "Page", "Issue", "Title", "MetaDescription", "Length", "Explanation"] and shaped.count()
    with pytest.raises(ValueError, match="already"):
        every.register("Broken", lambda *_: None)

"""A small crawl that triggers most rules, and helpers for tests."""

from __future__ import annotations

from siteloom import model

PROJECT = [(1, "site", "https://www.a.com/", "bot", 5, 1000, True, None)]
LONG = "word " * 400


def page(title="A title that is long enough for all", body=LONG, head="", lang="en", h1="Another headline here", meta=True) -> str:
    common = '<meta charset="utf-8"><meta name="viewport" content="w"><meta name="description" content="Learn all about the harbour and its many boats today and tomorrow.">' if meta else ""
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>{title}</title>{common}{head}</head><body><h1>{h1}</h1>{body}</body></html>'


def crawl(spark, pages: list[dict], headers=(), links=(), redirects=(), sitemaps=(), robots=(("www.a.com", "User-agent: *\nDisallow: /x"),), external=(), probes=(), rules=()) -> model.Crawl:
    """pages: url, html (None: not HTML), and perhaps depth, status, target, loop."""
    urls = [(i, 1, p["url"], p.get("depth", 1), 2, p.get("status", 200), p.get("type", "text/html; charset=utf-8"), 10, None, None, True, p.get("target"), p.get("loop", False)) for i, p in enumerate(pages, 1)]
    frame = lambda rows, name: spark.createDataFrame(list(rows), model.schema(name))
    return model.Crawl(
        spark, projects=frame(PROJECT, "projects"), urls=frame(urls, "urls"), page_html=frame([(i, 1, p["url"], p["html"]) for i, p in enumerate(pages, 1) if p.get("html") is not None], "page_html"),
        headers=frame([(u, n, v, i) for i, (u, n, v) in enumerate(headers)], "headers"), links=frame(links, "links"), redirects=frame(redirects, "redirects"), sitemaps=frame(sitemaps, "sitemaps"),
        robots_txt=frame(robots, "robots_txt"), external_status=frame(external, "external_status"), variant_probe=frame(probes, "variant_probe"), extraction_rules=frame(rules, "extraction_rules"),
    )


def issues(found) -> dict[int, set[str]]:
    out: dict = {}
    for x in found.collect():
        out.setdefault(x.url_id, set()).add(x.issue)
    return out

"""What other parts ask of the crawl tables: URLs in crawl order, redirects with their sources, first hops, links from parsed pages, changes to single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.model import Crawl

AGENTS = {
    "chrome": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "firefox": "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "safari": "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
}


def user_agent(kind: Column, key: Column) -> Column:
    """The agent of a name; ``random`` draws one by the hash of ``key``, the same for the same key; an unknown name is itself the agent."""
    every = F.array(*(F.lit(x) for x in AGENTS.values()))
    drawn = F.element_at(every, (F.pmod(F.xxhash64(key), F.lit(len(AGENTS))) + 1).cast("int"))
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in AGENTS.items() for x in kv)), F.lower(kind))
    return F.when(F.lower(kind) == "random", drawn).otherwise(F.coalesce(named, kind))


def in_order(urls: DataFrame, project: int) -> DataFrame:
    """A project's URLs by depth, then first sight, then id."""
    return urls.where(F.col("project_id") == project).orderBy("depth", "first_seen", "url_id")


def by_id(urls: DataFrame, url_id: int) -> DataFrame:
    return urls.where(F.col("url_id") == url_id)


def by_address(urls: DataFrame, project: int, address: str) -> DataFrame:
    """The project's URLs with the normal form of an address."""
    return urls.where((F.col("project_id") == project) & (U.normalize(F.col("address")) == U.normalize(F.lit(address))))


def redirects_with_source(crawl: Crawl) -> DataFrame:
    """(project_id, source, from_url, to_url, status_code, position): source is the page's address, or ``[Unknown URL ID: n]`` where the page is not there."""
    known = crawl.urls.select("url_id", "project_id", "address")
    source = F.coalesce("address", F.format_string("[Unknown URL ID: %d]", "url_id"))
    return crawl.redirects.join(known, "url_id", "left").select("project_id", source.alias("source"), "from_url", "to_url", "status_code", "position")


def first_hops(crawl: Crawl) -> DataFrame:
    """(url_id, to_url, status_code): each page's hop of the least position, of equals the least address."""
    return crawl.redirects.groupBy("url_id").agg(F.min_by(F.struct("to_url", "status_code"), F.struct("position", "to_url")).alias("x")).select("url_id", "x.*")


def last_opened(projects: DataFrame, n: int = 5) -> DataFrame:
    """The projects opened last."""
    return projects.orderBy(F.desc_nulls_last("last_opened"), "project_id").limit(n)


def links(ctx: DataFrame) -> DataFrame:
    """The link table from parsed pages: (project_id, from_url_id, url, norm, anchor_text, link_type, rel, is_nofollow, is_ugc, is_sponsored, dom_path) of anchors (0), images (1), scripts (2), style sheets (3).

    An anchor around an image has its alternative text; rel values are found within the attribute, whatever their case. Addresses of scripts, mail and telephones, and fragments, are no links.
    """
    blank, none = F.lit(""), F.lit(None).cast("string")
    link = lambda url, text, kind, rel: F.struct(url.alias("url"), text.alias("anchor_text"), F.lit(kind).cast("tinyint").alias("link_type"), rel.alias("rel"))
    fine = lambda u: (F.coalesce(u, blank) != "") & ~F.lower(F.coalesce(u, blank)).rlike("^(javascript:|mailto:|tel:|data:|#)")
    parts = [
        F.transform(F.filter("anchors", lambda a: fine(a["href"])), lambda a: link(a["url"], a["text"], 0, F.nullif(a["rel"], blank))), F.transform(F.filter("images", lambda i: fine(i["src"])), lambda i: link(i["url"], i["alt"], 1, none)),
        F.transform(F.filter("scripts", lambda s: fine(s["src"])), lambda s: link(s["url"], blank, 2, none)), F.transform(F.filter("stylesheets", lambda s: fine(s["href"])), lambda s: link(s["url"], blank, 3, none)),
    ]
    rows = ctx.where("has_html").select("project_id", F.col("url_id").alias("from_url_id"), F.explode(F.concat(*parts)).alias("l")).select("project_id", "from_url_id", "l.*")
    has = lambda word: F.lower(F.coalesce("rel", blank)).contains(word)
    return rows.select("project_id", "from_url_id", "url", U.normalize(F.col("url")).alias("norm"), "anchor_text", "link_type", "rel", has("nofollow").alias("is_nofollow"), has("ugc").alias("is_ugc"), has("sponsored").alias("is_sponsored"), none.alias("dom_path"))


def stored_links(ctx: DataFrame, urls: DataFrame) -> DataFrame:
    """``links`` as the table of links holds them: those whose target is a known URL of the project, by its id (the least of equal normal forms)."""
    known = urls.groupBy("project_id", U.normalize(F.col("address")).alias("norm")).agg(F.min("url_id").alias("to_url_id"))
    return links(ctx).join(known, ["project_id", "norm"]).select("project_id", "from_url_id", "to_url_id", "anchor_text", "link_type", "rel", "is_nofollow", "is_ugc", "is_sponsored", "dom_path")


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``changes`` in place of, or beside, what has their keys; the keys of ``changes`` are unique."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose keys are in ``gone``."""
    return rows.join(gone.select(*keys), keys, "left_anti").select(rows.columns)

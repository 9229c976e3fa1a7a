"""A crawl from the raw table of pages: hosts are projects, and what raw pages lack (depth, status, redirects) follows from page_id by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import model
from siteloom.functions import urls as U

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
LANG = r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)"
CHARSET = r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_-]+)"
ANCHOR = r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(html: Column) -> Column:
    return squeezed(F.regexp_replace(html, r"<[^>]*>", ""))


def status() -> Column:
    k = F.col("page_id") % 20
    return F.when(k == 0, 404).when(k == 1, 500).when(k == 2, 301).when(k == 3, 302).otherwise(200)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, depth, status, site): the raw table and its overlay; pruned to what a query names."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({"depth": (F.col("page_id") % 5).cast("int"), "status": status(), "site": U.host(F.col("url"))})


def features(rows: DataFrame) -> DataFrame:
    """Native columns of the markup: title, h1, lang, charset, n_h1. Patterns only, so that plans stay in the JVM."""
    return rows.withColumns({
        "title": plain(F.regexp_extract("html", TITLE, 1)), "h1": plain(F.regexp_extract("html", H1, 1)), "lang": F.regexp_extract("html", LANG, 1),
        "charset": F.lower(F.regexp_extract("html", CHARSET, 1)), "n_h1": F.size(F.regexp_extract_all("html", F.lit(H1), 0)),
    })


def links(rows: DataFrame) -> DataFrame:
    """(page_id, url, site, href, anchor, target) of the markup's anchors, resolved."""
    found = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    each = rows.select("page_id", "url", "site", F.explode(found).alias("a")).select("page_id", "url", "site", F.regexp_extract("a", ANCHOR, 1).alias("href"), plain(F.regexp_extract("a", ANCHOR, 2)).alias("anchor"))
    return each.where(~F.lower("href").rlike("^(javascript:|mailto:|tel:|#)")).withColumn("target", U.resolve(F.col("url"), F.col("href")))


def redirects(rows: DataFrame) -> DataFrame:
    """(source, target, code): a page of status 3xx leads to the page five further on, whose status is not always good."""
    other = rows.select((F.col("page_id") - 5 * (F.col("page_id") % 2) - 20).alias("page_id"), U.normalize(F.col("url")).alias("target"))
    return rows.where("status between 300 and 399").select("page_id", U.normalize(F.col("url")).alias("source"), F.col("status").alias("code")).join(other, "page_id").select("page_id", "source", "target", "code")


def crawl(spark: SparkSession, sf_dir: str) -> model.Crawl:
    """The tables that tasks read, one project a host."""
    raw = pages(spark, sf_dir)
    project = F.pmod(F.xxhash64("site"), F.lit(2**31 - 1)).cast("int")
    rows = raw.withColumn("project_id", project)
    projects = rows.groupBy("project_id").agg(F.min("site").alias("name"), F.min(F.concat(U.origin(F.col("url")), F.lit("/"))).alias("base_url")).withColumns({"user_agent": F.lit("bot"), "max_depth": F.lit(5), "max_urls": F.lit(1000), "respect_robots": F.lit(True), "last_opened": F.lit(None).cast("timestamp")})
    none = lambda kind: F.lit(None).cast(kind)
    urls = rows.select(F.col("page_id").alias("url_id"), "project_id", F.col("url").alias("address"), "depth", F.lit(2).cast("tinyint").alias("status"), F.col("status").alias("http_status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.octet_length("html").cast("long").alias("content_length"), none("timestamp").alias("first_seen"), none("timestamp").alias("last_crawled"), F.lit(True).alias("robots_allowed"), none("string").alias("redirect_target"), F.lit(False).alias("is_redirect_loop"))
    edges = links(rows).select("page_id", U.normalize(F.col("target")).alias("norm"), "anchor")
    known = rows.select("project_id", F.col("page_id").alias("to_url_id"), U.normalize(F.col("url")).alias("norm")).dropDuplicates(["norm"])
    stored = edges.join(known, "norm").select("project_id", F.col("page_id").alias("from_url_id"), "to_url_id", F.col("anchor").alias("anchor_text"), F.lit(0).cast("tinyint").alias("link_type"), none("string").alias("rel"), F.lit(False).alias("is_nofollow"), F.lit(False).alias("is_ugc"), F.lit(False).alias("is_sponsored"), none("string").alias("dom_path"))
    hops = redirects(raw).select(F.col("page_id").alias("url_id"), F.col("source").alias("from_url"), F.col("target").alias("to_url"), F.col("code").alias("status_code"), F.lit(0).alias("position"))
    return model.Crawl(spark, projects=projects, urls=urls, page_html=rows.select(F.col("page_id").alias("url_id"), "project_id", F.col("url").alias("address"), "html"), links=stored, redirects=hops)

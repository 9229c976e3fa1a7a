"""Sources beside the crawl tables: URL lists, robots.txt, sitemaps, and lookups over the tables."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import urls as U

MOST_URLS, MOST_BYTES = 50_000, 50 << 20
COMMON_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap1.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml", "/sitemap.xml.gz")


def url_list(spark: SparkSession, path: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to queue, one row of counts) of a CSV with Url and, perhaps, Priority. Blank URLs are dropped, invalid ones counted, known and repeated ones skipped."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    named = {c.lower(): c for c in raw.columns}
    priority = F.expr(f"try_cast(`{named['priority']}` as int)") if "priority" in named else F.lit(None).cast("int")
    rows = raw.select(F.trim(F.col(named["url"])).alias("address"), F.coalesce(priority, F.lit(1000)).alias("priority")).where("address is not null and address != ''").withColumn("valid", U.is_http(F.col("address")) & U.is_absolute(F.col("address"))).withColumn("norm", U.normalize_with_query(F.col("address")))
    one = rows.where("valid").groupBy("norm").agg(F.min_by("address", F.struct(-F.col("priority"), "address")).alias("address"), F.max("priority").alias("priority"))
    if known is not None:
        one = one.join(known.select(U.normalize_with_query(F.col("address")).alias("norm")).distinct(), "norm", "left_anti")
    queue = one.select("address", "priority", F.lit(0).alias("depth"), U.host(F.col("address")).alias("host_key"), F.lit(0).cast("tinyint").alias("state"))
    counts = rows.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")).crossJoin(one.agg(F.count("*").alias("imported"))).select("imported", (F.col("valid") - F.col("imported")).alias("skipped"), "invalid")
    return queue, counts


def robots_rules(robots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, delays, sitemap lines) of robots_txt(host, content): the agent of a line is the last one named above it."""
    lines = robots.select("host", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("at", "line")).select("host", "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    keyed = lines.select("host", "at", F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))
    agent = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    owned = keyed.withColumn("agent", agent)
    rules = owned.where("agent is not null and key in ('allow', 'disallow') and value != ''").select("host", "agent", F.col("value").alias("prefix"), (F.col("key") == "allow").alias("allow"), "at")
    delays = owned.where("agent is not null and key = 'crawl-delay'").select("host", "agent", F.expr("try_cast(value as double)").alias("delay")).where("delay is not null").groupBy("host", "agent").agg(F.max("delay").alias("delay"))
    sitemaps = keyed.where("key = 'sitemap' and value != ''").select("host", F.col("value").alias("sitemap"))
    return rules, delays, sitemaps


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` and ``allowed``: the longest prefix among rules for ``*`` or an agent that is part of ours decides; without one, or without robots.txt, it is allowed."""
    ours = rules.where((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent")))
    gathered = ours.groupBy("host").agg(F.collect_list(F.struct(F.length("prefix").alias("size"), (-F.col("at")).alias("order"), "prefix", "allow")).alias("rules"))
    with_host = urls.withColumn("host", U.host(F.col("address"))).withColumn("full_path", F.concat(U.path(F.col("address")), U.query(F.col("address"))))
    best = F.array_max(F.filter("rules", lambda r: F.col("full_path").startswith(r["prefix"])))
    return with_host.join(gathered, "host", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "host", "full_path")


def crawl_delay(delays: DataFrame, agent: str, cap: float = 10.0) -> DataFrame:
    """(host, delay): that of our agent, else of ``*``, capped."""
    own = F.max(F.when(F.col("agent") == agent.lower(), F.col("delay")))
    return delays.groupBy("host").agg(F.least(F.coalesce(own, F.max(F.when(F.col("agent") == "*", F.col("delay")))), F.lit(cap)).alias("delay")).where("delay is not null")


def unpacked(content: bytes) -> tuple[str | None, str | None]:
    """Text of plain or gzipped bytes, or what is wrong."""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError) as e:
            return None, f"gzip: {e}"
    return content.decode("utf-8", "replace"), None


SITEMAP = "url string, bytes long, kind string, namespaced boolean, failure string, children array<string>, entries array<struct<at: int, loc: string, lastmod: string, priority: string>>"


def parse_sitemap(url: str, content: bytes | str | None) -> dict:
    """kind: ``urlset``, ``index``, ``empty`` (no content), ``gzip`` or ``broken``."""
    raw = content.encode() if isinstance(content, str) else content or b""
    out = {"url": url, "bytes": len(raw), "kind": "empty", "namespaced": False, "failure": None, "children": [], "entries": []}
    if not raw.strip():
        return out
    text, failure = unpacked(raw)
    if failure:
        return out | {"kind": "gzip", "failure": failure}
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        return out | {"kind": "broken", "failure": str(e)}
    local = lambda e: e.tag.rpartition("}")[2]
    value = lambda e, name: next(((c.text or "").strip() for c in e if local(c) == name), None)
    out["namespaced"] = root.tag.startswith("{http")
    out["bytes"] = len(text.encode())
    if local(root) == "sitemapindex":
        return out | {"kind": "index", "children": [x for x in (value(e, "loc") for e in root) if x]}
    return out | {"kind": "urlset", "entries": [{"at": i, "loc": value(e, "loc"), "lastmod": value(e, "lastmod"), "priority": value(e, "priority")} for i, e in enumerate(x for x in root if local(x) == "url")]}


def sitemaps(table: DataFrame) -> DataFrame:
    """Parsed (SITEMAP) of sitemaps(url, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_sitemap(u, c) for u, c in zip(batch.url, batch.content, strict=True)], columns=re.findall(r"(?:^|, )(\w+) (?:string|long|boolean|array)", SITEMAP))

    return table.select("url", "content").mapInPandas(run, SITEMAP)


def candidates(projects: DataFrame, sitemap_lines: DataFrame) -> DataFrame:
    """(host, url) where sitemaps may lie: robots.txt lines and common places."""
    usual = projects.select(U.host(F.col("base_url")).alias("host"), F.explode(F.array(*(F.concat(U.origin(F.col("base_url")), F.lit(p)) for p in COMMON_SITEMAPS))).alias("url"))
    return usual.unionByName(sitemap_lines.select("host", F.col("sitemap").alias("url"))).distinct()


def discover(parsed: DataFrame, starts: DataFrame, rounds: int = 10) -> DataFrame:
    """(loc): URLs of the sitemaps that ``starts`` (url) reach through indexes, each visited once, the first MOST_URLS by name; invalid URLs are dropped."""
    visited = frontier = starts.select("url").distinct()
    for _ in range(rounds):
        frontier = parsed.join(frontier, "url", "left_semi").select(F.explode("children").alias("url")).distinct().join(visited, "url", "left_anti")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return parsed.join(visited, "url", "left_semi").select(F.explode("entries.loc").alias("loc")).where(U.is_http(F.col("loc"))).distinct().orderBy("loc").limit(MOST_URLS)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Upsert: of rows with equal keys the last by ``order`` (ties by all columns, so that reruns agree)."""
    window = Window.partitionBy(*keys).orderBy(order.desc(), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def header_map(headers: DataFrame) -> DataFrame:
    """(url_id, headers): by lower-case name, the first value; set-cookie keeps all values, a line each."""
    one = headers.groupBy("url_id", F.lower("name").alias("name")).agg(F.min_by("value", F.coalesce("seq", F.lit(0))).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("all"))
    value = F.when(F.col("name") == "set-cookie", F.col("all")).otherwise(F.col("first"))
    return one.groupBy("url_id").agg(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value")))).alias("headers"))

"""Tasks over sitemaps, structured data and user-defined extractions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.model import ERROR, INFO, WARNING, Crawl
from siteloom.operators.base import ROW, rows, rule, small, standard
from siteloom.operators.graph_rules import statuses
from siteloom.sources import files, html_dom

SAMPLE, COMPARED = 100, 1000


def sitemap(crawl: Crawl, ctx: DataFrame, now: str | None = None, compat: bool = False) -> DataFrame:
    """``now`` fixes the clock; ``compat``: a sitemap URL that was crawled below the start counts as orphan whatever links to it."""
    is_map = F.lower(U.path(F.col("address"))).rlike(r"sitemap[^/]*\.xml(\.gz)?$")
    own = ctx.where(F.col("internal") & is_map).select("project_id", "url_id", "page", "http_status")
    clock = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    parsed = files.sitemaps(crawl.sitemaps)
    joined = own.join(parsed, F.col("page") == F.col("url"), "left")
    kind, status, n = F.coalesce("kind", F.lit("empty")), F.col("http_status"), F.size("entries")
    good = status.between(200, 299)
    head = F.slice("entries", 1, SAMPLE)
    joined = joined.withColumns({"kind": kind, "head": head}).withColumns({
        "invalid": F.size(F.filter("head", lambda e: ~F.coalesce(U.is_http(e["loc"]), F.lit(False)))),
        "future": F.size(F.filter("head", lambda e: F.coalesce(F.try_to_timestamp(e["lastmod"]) > clock, F.lit(False)))),
        "old": F.size(F.filter("head", lambda e: F.coalesce(F.datediff(clock, F.try_to_timestamp(e["lastmod"])) > 730, F.lit(False)))),
        "off": F.size(F.filter("head", lambda e: F.coalesce(~e["priority"].try_cast("double").between(0, 1), F.lit(False)))),
        "rated": F.size(F.filter("head", lambda e: e["priority"].try_cast("double").isNotNull())),
        "top": F.size(F.filter("head", lambda e: F.coalesce(e["priority"].try_cast("double") >= 0.99, F.lit(False)))),
    })
    kind, urlset = F.col("kind"), F.col("kind") == "urlset"
    r = lambda when, issue, severity: rule(when, issue, severity, "", InSitemap="Yes", StatusCode=status)
    count = lambda c, t: F.format_string(t, c if not isinstance(c, str) else F.col(c))
    mb = F.col("bytes") / F.lit(1048576.0)
    missing, barred = status == 404, status.isin(401, 403, 451)
    page = rows(joined, "Sitemap", [
        r(missing, "Sitemap Not Found", WARNING), r(barred, count(status, "Sitemap Restricted (HTTP %d)"), INFO), r((status >= 400) & ~missing & ~barred, count(status, "Sitemap Error (HTTP %d)"), ERROR),
        r(good & (kind == "empty"), "Sitemap Returned No Content", WARNING), r(good & (kind == "gzip"), "Gzip Decompression Error", ERROR),
        r(F.col("bytes") > 50 << 20, count(mb, "Sitemap Too Large (%.2fMB)"), ERROR), r((F.col("bytes") > 40 << 20) & (F.col("bytes") <= 50 << 20), count(mb, "Sitemap Large (%.2fMB)"), WARNING),
        r(good & kind.isin("urlset", "index") & ~F.col("namespaced"), "Invalid Sitemap XML (Missing Namespace)", WARNING),
        r(good & (kind == "index"), count(F.size("children"), "Sitemap Index (%d sitemaps)"), INFO), r(good & (kind == "broken"), F.concat(F.lit("Sitemap Parse Error: "), F.coalesce("failure", F.lit(""))), ERROR),
        r(good & urlset & (n == 0), "Empty Sitemap", WARNING), r(urlset & (n > 50000), count(n, "URL Limit Exceeded (%,d URLs)"), ERROR), r(urlset & n.between(45001, 50000), count(n, "Approaching URL Limit (%,d URLs)"), WARNING),
        r(good & urlset & n.between(1, 45000), count(n, "Sitemap Parsed (%,d URLs)"), INFO),
        r(urlset & (F.col("rated") >= 10) & (F.col("top") == F.col("rated")), "All Priority 1.0 (Defeats Purpose)", WARNING), r(urlset & (F.col("invalid") > 0), count("invalid", "Invalid URLs (%d)"), WARNING),
        r(urlset & (F.col("future") > 0), count("future", "Future Lastmod Dates (%d)"), WARNING), r(urlset & (F.col("old") > 10), count("old", "Outdated URLs (%d > 2 years old)"), INFO), r(urlset & (F.col("off") > 0), count("off", "Invalid Priority Values (%d)"), ERROR),
    ])
    entries = joined.where(urlset).select("project_id", "url_id", "page", "http_status", F.explode("entries").alias("e")).select("project_id", "url_id", "page", "http_status", "e.at", U.normalize(F.col("e.loc")).alias("norm")).where("norm is not null")
    sampled = entries.where(F.col("at") < COMPARED).join(statuses(crawl), ["project_id", "norm"]).groupBy("project_id", "url_id", "page", "http_status").agg(F.count_if(F.col("target_status") == 404).alias("n404"), F.count_if(F.col("target_status") >= 500).alias("n500"), F.count_if(F.col("target_status").between(300, 399)).alias("n300"))
    states = rows(sampled, "Sitemap", [r(F.col("n404") > 0, count("n404", "Sitemap Contains 404s (%d URLs)"), ERROR), r(F.col("n500") > 0, count("n500", "Sitemap Contains 5xx Errors (%d URLs)"), ERROR), r(F.col("n300") > 0, count("n300", "Sitemap Contains Redirects (%d URLs)"), WARNING)])
    listed = entries.select("project_id", F.lower("norm").alias("norm")).distinct()
    crawled = standard(ctx).select("project_id", "url_id", "depth", F.lower(U.normalize(F.col("page"))).alias("norm"), "anchors", "page")
    linked = crawled.select("project_id", "norm", F.explode("anchors").alias("a")).select("project_id", F.col("norm").alias("own"), F.lower(U.normalize(F.col("a.url"))).alias("norm")).where("own != norm").select("project_id", "norm").distinct()
    within = crawled.join(listed, ["project_id", "norm"], "left_semi").where("depth > 0")
    lonely = within if compat else within.join(linked, ["project_id", "norm"], "left_anti")
    unlisted = crawled.join(listed, ["project_id", "norm"], "left_anti").join(listed.select("project_id").distinct(), "project_id", "left_semi")
    sites = crawl.projects.select("project_id", F.col("base_url").alias("page"), F.lit(None).cast("long").alias("url_id"), F.lit(None).cast("int").alias("http_status"))
    totals = sites.join(lonely.groupBy("project_id").agg(F.count("*").alias("n_lonely")), "project_id", "left").join(unlisted.groupBy("project_id").agg(F.count("*").alias("n_unlisted")), "project_id", "left")
    return page.unionByName(states).unionByName(rows(totals, "Sitemap", [r(F.col("n_lonely") > 0, count("n_lonely", "Orphan URLs in Sitemap (%d)"), WARNING), r(F.col("n_unlisted") > 0, count("n_unlisted", "URLs Missing from Sitemap (%d)"), INFO)]))


def kind_of(root: dict) -> str:
    kind = root.get("@type", "")
    return kind[0] if isinstance(kind, list) and kind else kind if isinstance(kind, str) else ""


def lacking(root: dict, *names: str) -> list[str]:
    return [n for n in names if not any(p in root for p in n.split(" or "))]


def number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def is_date(value) -> bool:
    try:
        datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def rating_notes(root: dict) -> list[str]:
    rating = root.get("aggregateRating")
    if not isinstance(rating, dict):
        return ["aggregateRating is recommended"]
    out, value = [], number(rating.get("ratingValue"))
    out += [] if value is not None else ["ratingValue is missing"]
    out += [] if "reviewCount" in rating or "ratingCount" in rating else ["reviewCount or ratingCount is missing"]
    best = number(rating.get("bestRating")) or 5
    return out + (["ratingValue is out of range"] if value is not None and not 0 <= value <= best else [])


def offer_notes(root: dict) -> list[str]:
    offers, out = root.get("offers"), []
    for offer in offers if isinstance(offers, list) else [offers] if offers else []:
        if isinstance(offer, dict):
            out += [f"offer lacks {n}" for n in lacking(offer, "price or lowPrice", "priceCurrency", "availability")]
            if "price" in offer and number(offer["price"]) is None:
                out.append("price is no number")
    return out


def validated(root: dict) -> list[tuple]:
    """(issue, severity, property) of one JSON-LD object by its type."""
    kind, out = kind_of(root), []
    listed = lambda issue, severity, lost: out.append((issue, severity, ", ".join(lost))) if lost else None
    if kind in ("Article", "NewsArticle", "BlogPosting"):
        listed("Incomplete Article Schema", WARNING, lacking(root, "headline", "author", "datePublished", "image"))
    elif kind == "Product":
        listed("Incomplete Product Schema", ERROR, lacking(root, "name", "image", "offers or price"))
        notes = offer_notes(root) + rating_notes(root) + [f"{n} is recommended" for n in lacking(root, "brand", "description")]
        if notes:
            out.append((f"Product Recommendations ({len(notes)})", WARNING, ", ".join(notes[:2])))
        elif "aggregateRating" in root:
            out.append(("Complete with Star Ratings", INFO, "aggregateRating"))
    elif kind == "VideoObject":
        listed("Incomplete Video Schema", ERROR, lacking(root, "name", "description", "thumbnailUrl", "uploadDate", "contentUrl or embedUrl"))
        notes = [f"{n} is recommended" for n in lacking(root, "duration", "interactionStatistic")]
        notes += ["thumbnailUrl is no URL"] if "thumbnailUrl" in root and not isinstance(root["thumbnailUrl"], (str, list)) else []
        notes += ["uploadDate is no date"] if root.get("uploadDate") and not is_date(root["uploadDate"]) else []
        notes += ["duration is no ISO 8601"] if root.get("duration") and not str(root["duration"]).startswith("PT") else []
        if notes:
            out.append((f"Video Recommendations ({len(notes)})", WARNING, ", ".join(notes[:2])))
    elif kind == "Review":
        lost = lacking(root, "itemReviewed", "reviewRating", "author")
        listed("Incomplete Review Schema", ERROR, lost)
        rating, body = root.get("reviewRating"), root.get("reviewBody")
        value = number(rating.get("ratingValue")) if isinstance(rating, dict) else None
        notes = (["ratingValue should be 1 to 5"] if value is not None and not 1 <= value <= 5 else []) + (["reviewBody is recommended"] if not body else ["reviewBody is short"] if len(str(body)) < 50 else []) + [f"{n} is recommended" for n in lacking(root, "datePublished")]
        if notes:
            out.append((f"Review Recommendations ({len(notes)})", WARNING, ", ".join(notes[:2])))
        elif not lost:
            out.append(("Review Schema Complete", INFO, "reviewRating"))
    elif kind in ("LocalBusiness", "Organization"):
        lost = lacking(root, "name", "url", *(["address"] if kind == "LocalBusiness" else []))
        listed("Incomplete LocalBusiness Schema", WARNING, lost)
        if kind == "LocalBusiness":
            address, phone, hours = root.get("address"), root.get("telephone"), root.get("openingHours")
            notes = [f"address lacks {n}" for n in lacking(address, "streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")] if isinstance(address, dict) else ["address should be structured"] if isinstance(address, str) else []
            notes += ["telephone is recommended"] if "telephone" not in root else ["telephone should be international"] if phone and not str(phone).startswith("+") else []
            if isinstance(hours, list):
                notes += ["openingHours is empty"] if not hours else ["openingHours has no times"] if not any(x in str(hours[0]) for x in "-:") else []
            elif isinstance(hours, str):
                notes.append("openingHours should be an array")
            notes += [f"{n} is recommended" for n in lacking(root, "geo")]
            if notes:
                out.append((f"LocalBusiness Recommendations ({len(notes)})", WARNING, ", ".join(notes[:2])))
    elif kind == "BreadcrumbList":
        items = root.get("itemListElement")
        if items is None:
            out.append(("Missing itemListElement", WARNING, "itemListElement"))
        elif isinstance(items, list):
            out.append(("Empty BreadcrumbList", WARNING, "itemListElement") if not items else (f"Breadcrumb Found ({len(items)} levels)", INFO, "itemListElement"))
    elif kind in ("FAQPage", "QAPage"):
        items = root.get("mainEntity")
        if items is None:
            out.append(("Missing mainEntity", WARNING, "mainEntity"))
        else:
            texts = [str((q.get("acceptedAnswer") or {}).get("text") or "") if isinstance(q, dict) and isinstance(q.get("acceptedAnswer") or {}, dict) else "" for q in (items if isinstance(items, list) else [items])]
            lost, short = sum(not t for t in texts), sum(0 < len(t) < 50 for t in texts)
            if lost:
                out.append((f"FAQ Missing Answers ({lost})", WARNING, "acceptedAnswer"))
            else:
                out.append((f"FAQ Complete ({len(texts)} Q&As)", INFO, "mainEntity"))
            if short:
                out.append((f"FAQ Short Answers ({short})", INFO, "acceptedAnswer"))
    elif kind == "HowTo" and "step" not in root:
        out.append(("Missing step", WARNING, "step"))
    return out


def json_ld(blocks: list[str]) -> tuple[list[tuple], list[str], list[tuple]]:
    """(findings (type, issue, severity, property), types, businesses (name, address, phone)) of a page's blocks; array roots and @graph fan out."""
    found, types, businesses = [], [], []
    for block in blocks:
        try:
            root = json.loads(block)
        except ValueError as e:
            found.append(("JSON-LD", f"JSON Syntax Error: {e}", ERROR, str(e)))
            continue
        for one in root if isinstance(root, list) else [root]:
            if not isinstance(one, dict):
                continue
            if kind := kind_of(one):
                types.append(kind)
            found += [(kind, *x) for x in validated(one)]
            if kind == "LocalBusiness" and one.get("name") and one.get("telephone"):
                address = one.get("address")
                businesses.append((str(one["name"]), " ".join(str(v) for k, v in sorted(address.items()) if not k.startswith("@")) if isinstance(address, dict) else str(address or ""), str(one["telephone"])))
    return found, types, businesses


def structured_data(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, blocks in zip(batch.url_id, batch.jsonld, strict=True):
                found, types, businesses = json_ld(list(blocks))
                out.append((i, [dict(zip(("kind", "issue", "severity", "property"), x, strict=True)) for x in found], types, [dict(zip(("name", "address", "phone"), x, strict=True)) for x in businesses]))
            yield pd.DataFrame(out, columns=["url_id", "found", "types", "businesses"])

    own = standard(ctx)
    read = own.where(F.size("jsonld") > 0).select("url_id", "jsonld").mapInPandas(run, "url_id long, found array<struct<kind: string, issue: string, severity: int, property: string>>, types array<string>, businesses array<struct<name: string, address: string, phone: string>>")
    joined = own.join(read, "url_id", "left")
    each = joined.select("project_id", "url_id", "page", F.explode("found").alias("f"))
    schemas = rows(each, "StructuredData", [rule(F.lit(True), F.col("f.issue"), F.col("f.severity"), "", SchemaType=F.col("f.kind"), Property=F.col("f.property"))])
    low, body = F.lower("page"), F.coalesce("body", F.lit(""))
    wanted = F.when(low.rlike("/(blog|article|post|news)/"), "Article or BlogPosting").when(low.rlike("/(product|item|shop)/"), "Product").when(low.rlike("/(about|contact|company)/"), "Organization")
    article = low.rlike("/(blog|article|post|news)/") | F.col("has_article")
    byline = body.rlike(r"\bby\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b") | F.lower(body).rlike(r"\bauthor:\s*\w+|\bwritten by\s+\w+")
    contact = low.rlike("/(contact|about|company|location)/") | (U.path(F.col("page")) == "/")
    phone = body.rlike(r"\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{1,4}[\s\-]?\d{1,9}|\(\d{3}\)\s*\d{3}[\-\s]?\d{4}|\d{3}[\-.\s]\d{3}[\-.\s]\d{4}")
    place = body.rlike(r"\d+\s+[A-Z][a-z]+\s+(Ave|Avenue|Blvd|Boulevard|Court|Ct|Dr|Drive|Lane|Ln|Rd|Road|St|Street|Way)|[A-Z][a-z]+,\s*[A-Z]{2}\s+\d{5}|\d{5}(-\d{4})?")
    r = lambda when, issue, severity, kind="", name="": rule(when, issue, severity, "", SchemaType=kind, Property=name)
    page = rows(joined, "StructuredData", [
        r(F.size(F.coalesce("types", F.array().cast("array<string>"))) > 0, F.format_string("JSON-LD Found (%d schemas)", F.size("types")), INFO, F.array_join(F.array_distinct("types"), ", "), "@type"),
        r(F.size("itemtypes") > 0, F.format_string("Microdata Found (%d items)", F.size("itemtypes")), INFO, F.array_join(F.array_distinct("itemtypes"), ", "), "itemtype"),
        r((F.size("jsonld") == 0) & ~F.col("has_itemscope") & (F.col("depth") <= 2) & wanted.isNotNull(), "Missing Structured Data", INFO, wanted, wanted),
        r(article & ~F.col("has_rel_author") & ~byline, "Missing Author Markup", INFO, "Article", "author"),
        r(contact & ~phone & ~place, "Missing Contact Info", INFO, "Organization", "telephone, address"),
        r(contact & ~phone & place, "Missing Phone Number", INFO, "Organization", "telephone"),
        r(contact & phone & ~place, "Missing Address", INFO, "Organization", "address"),
    ])
    every = joined.select("project_id", "url_id", "page", F.explode("businesses").alias("b"))
    differ = every.groupBy("project_id").agg(F.count_distinct(F.lower("b.name")).alias("names"), F.count_distinct(F.lower("b.address")).alias("places"), F.count_distinct("b.phone").alias("phones"), F.min(F.struct("url_id", "page")).alias("first")).select("project_id", "first.*", "names", "places", "phones")
    nap = rows(differ, "StructuredData", [r((F.col("names") > 1) | (F.col("places") > 1) | (F.col("phones") > 1), F.format_string("NAP Inconsistency (%d names, %d phones)", "names", "phones"), WARNING, "LocalBusiness", F.format_string("%d names, %d addresses, %d phones", "names", "places", "phones"))])
    return schemas.unionByName(page).unionByName(latch(nap))


def extraction(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    """A row for each page and enabled rule with values; a rule that fails is a row of its own."""
    own = ctx.where(F.col("has_html") & ok_pages()).select("project_id", "url_id", "page")
    rules = crawl.extraction_rules.select("rule_id", "name", "selector")
    found = html_dom.extractions(crawl.page_html, crawl.extraction_rules).join(own, "url_id").join(small(rules), "rule_id")
    kept = F.filter(F.transform("values", lambda v: F.trim(v)), lambda v: v.isNotNull())
    return rows(found.withColumn("kept", kept), "CustomExtraction", [
        rule(F.size("kept") > 0, F.col("name"), INFO, "", RuleName=F.col("name"), ExtractedValue=F.array_join("kept", "\n"), Selector=F.col("selector"), Count=F.size("kept")),
        rule(F.col("failure").isNotNull(), F.concat(F.lit("Extraction failed: "), F.col("name")), WARNING, F.col("failure"), RuleName=F.col("name"), ExtractedValue="ERROR", Selector=F.col("selector"), Count=0),
    ])


def ok_pages():
    return F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & F.col("internal")


def pivot(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Page by rule: enabled rules by name first, then other rules as they come; values joined by lines, and the worst severity."""
    enabled = [r.name for r in rules.where("is_enabled").select("name").distinct().orderBy("name").collect()]
    own = found.where("task_key = 'CustomExtraction'").select(F.col("page"), F.lower("page").alias("key"), F.col("fields")["RuleName"].alias("rule"), F.col("fields")["ExtractedValue"].alias("value"), "severity", "url_id")
    unseen = [r.rule for r in own.groupBy("rule").agg(F.min("url_id").alias("at")).orderBy("at", "rule").collect() if r.rule not in enabled]
    wide = own.groupBy("key").pivot("rule", enabled + unseen).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n"))
    return own.groupBy("key").agg(F.min("page").alias("Page"), F.min("severity").alias("Severity")).join(wide, "key").drop("key")


def latch(found: DataFrame) -> DataFrame:
    """The first row of each project, for what is reported once."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("url_id", "issue"))).where("_n = 1").select(ROW)

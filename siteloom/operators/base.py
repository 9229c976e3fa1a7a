"""What audit tasks share: the page context, gates, and rules that become rows.

A rule is a column: null where it does not hold, else a struct of issue, severity, explanation and report fields. A task puts all of its rules for a page in one
array, so that pages are scanned once a task and exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import model
from siteloom.functions import urls as U
from siteloom.sources import files, html_dom

ROW_SCHEMA = "project_id int, task_key string, url_id long, page string, issue string, severity int, explanation string, fields map<string,string>"
ROW = ["project_id", "task_key", "url_id", "page", "issue", "severity", "explanation", "fields"]


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast ``df`` where the optimizer's size of it allows, which holds for any number of projects; beyond, the join is planned by its size."""
    limit = 32 << 20
    return F.broadcast(df) if html_dom.estimated_bytes(df) <= limit else df


def text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rule(when: Column, issue, severity, explanation="", **fields) -> Column:
    """One finding where ``when`` holds; severity may be a column."""
    pairs = [c for k, v in fields.items() for c in (F.lit(k), text(v).cast("string"))]
    mapped = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return F.when(when, F.struct(text(issue).cast("string").alias("issue"), text(severity).cast("int").alias("severity"), text(explanation).cast("string").alias("explanation"), mapped.alias("fields")))


def rows(ctx: DataFrame, task: str, rules: list[Column]) -> DataFrame:
    """ROW for every rule that holds on a row of ``ctx`` (project_id, url_id, page)."""
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return ctx.select("project_id", F.lit(task).alias("task_key"), "url_id", "page", F.explode(found).alias("f")).select("project_id", "task_key", "url_id", "page", "f.issue", "f.severity", "f.explanation", "f.fields")


def pages(crawl: model.Crawl, completed_only: bool = False) -> DataFrame:
    """The page context: urls, parsed features, first header values and base URL; ``completed_only`` leaves out what was not fetched well, as a crawl's own analysis does."""
    features = crawl.features if crawl.features is not None else html_dom.features(crawl.urls, crawl.page_html)
    urls = crawl.urls.where(F.col("status") == model.COMPLETED) if completed_only else crawl.urls
    projects = crawl.projects.select("project_id", "base_url")
    ctx = urls.join(small(projects), "project_id").join(features, "url_id", "left").join(files.header_map(crawl.headers), "url_id", "left")
    ctx = ctx.withColumns({"page": F.col("address"), "headers": F.coalesce("headers", F.expr("cast(map() as map<string,string>)")), "has_html": F.col("visible").isNotNull()})
    ctx = ctx.withColumn("internal", ~U.is_external(F.col("base_url"), F.col("address")))
    return ctx.withColumns(extracted())


def meta(name: str) -> Column:
    """Content of the first meta tag of a name or property; null without one."""
    return F.get(F.filter("metas", lambda m: m["name"] == name), F.lit(0))["content"]


def has_meta(name: str) -> Column:
    return F.exists(F.coalesce("metas", F.array().cast("array<struct<name:string,content:string>>")), lambda m: m["name"] == name)


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def directive(name: str, *sources: Column) -> Column:
    """Whether robots directives in meta or header say it; ``none`` is noindex and nofollow."""
    found = F.lit(False)
    for s in sources:
        own = F.lower(F.coalesce(s, F.lit("")))
        none = own.rlike(r"\bnone\b")
        found = found | (none if name in ("noindex", "nofollow") else F.lit(False)) | (~none & own.rlike(rf"\b{name}\b"))
    return found


def extracted() -> dict[str, Column]:
    """Columns that several tasks read: robots, canonicals, refresh, indexability."""
    robots, tag, link = meta("robots"), header("x-robots-tag"), header("link")
    http = F.regexp_extract(F.coalesce(link, F.lit("")), r"(?i)<([^>]+)>\s*;\s*rel=[\"']?canonical", 1)
    html = F.get("canonicals", F.lit(0))
    refresh = F.coalesce(meta("refresh"), F.lit(""))
    out = {"robots_meta": robots, "x_robots_tag": tag}
    out |= {f"robots_{d}": directive(d, robots, tag) for d in ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex")}
    differs = [directive(d, robots) != directive(d, tag) for d in ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex")]
    out["robots_conflict"] = robots.isNotNull() & tag.isNotNull() & (differs[0] | differs[1] | differs[2] | differs[3] | differs[4])
    out["is_indexable"] = ~out["robots_noindex"]
    out["canonical_html"] = F.when(html != "", html)
    out["canonical_http"] = F.when(http != "", U.resolve(F.col("address"), http))
    out["canonical"] = F.coalesce(F.when(html != "", html), F.when(http != "", U.resolve(F.col("address"), http)))
    out["has_multiple_canonicals"] = F.size(F.coalesce("canonicals", F.array().cast("array<string>"))) > 1
    out["refresh_delay"] = F.regexp_extract(refresh, r"(?i)(\d+)\s*;\s*url=(.+?)$", 1).try_cast("int")
    out["refresh_target"] = F.nullif(F.trim(F.regexp_extract(refresh, r"(?i)(\d+)\s*;\s*url=(.+?)$", 2)), F.lit(""))
    return out


def is_html() -> Column:
    return F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False))


def ok() -> Column:
    return F.coalesce(F.col("http_status").between(200, 299), F.lit(False))


def standard(ctx: DataFrame) -> DataFrame:
    """Internal HTML pages that were fetched well."""
    return ctx.where(is_html() & F.col("has_html") & ok() & F.col("internal"))


def shaped(found: DataFrame, task: str) -> DataFrame:
    """The task's own report: Severity, its columns in order, Explanation."""
    columns = []
    for name, kind in model.REPORTS[task].items():
        value = F.coalesce(F.try_element_at("fields", F.lit(name)), *([F.col("issue")] if name in ("Issue", "IssueType") else [F.col("page")] if name in ("Page", "URL", "Source", "FromURL", "LinkedFrom") else []))
        columns.append(value.try_cast(kind).alias(name))
    severity = F.element_at(F.array(*(F.lit(x) for x in model.SEVERITIES)), F.col("severity") + 1)
    return found.where(F.col("task_key") == task).select("project_id", "url_id", severity.alias("Severity"), *columns, F.col("explanation").alias("Explanation"))

"""Tasks that follow links: redirects, canonicals, internal links, broken links, the link graph.

Chains are bounded self-joins; statuses are one row for each normalised URL, joined to what points there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.model import ERROR, INFO, LINK_TYPES, WARNING, Crawl
from siteloom.operators.base import header, ok, rows, rule, standard, text

HOPS = 5


def statuses(crawl: Crawl) -> DataFrame:
    """(project_id, norm, target_status, target_address): of URLs with one normal form the last by depth, first sight and id."""
    known = crawl.urls.where("http_status is not null").withColumn("norm", U.normalize(F.col("address")))
    return known.groupBy("project_id", "norm").agg(F.max_by(F.struct("http_status", "address"), F.struct("depth", "first_seen", "url_id")).alias("x")).select("project_id", "norm", F.col("x.http_status").alias("target_status"), F.col("x.address").alias("target_address"))


def hop_map(crawl: Crawl, during: DataFrame | None = None) -> DataFrame:
    """(project_id, source, target, code): one hop for each normalised source; hops seen during analysis go before stored ones, then the last position."""
    own = crawl.redirects.join(crawl.urls.select("url_id", "project_id"), "url_id").select("project_id", "from_url", "to_url", "status_code", "position", F.lit(0).alias("rank"))
    if during is not None:
        own = own.unionByName(during.select("project_id", "from_url", "to_url", "status_code", "position", F.lit(1).alias("rank")))
    stored = crawl.urls.where(F.col("http_status").between(300, 399) & F.col("redirect_target").isNotNull()).select("project_id", F.col("address").alias("from_url"), U.resolve(F.col("address"), F.col("redirect_target")).alias("to_url"), F.col("http_status").alias("status_code"), F.lit(0).alias("position"), F.lit(-1).alias("rank"))
    every = own.unionByName(stored).where("trim(from_url) != '' and trim(to_url) != ''")
    return every.groupBy("project_id", U.normalize(F.col("from_url")).alias("source")).agg(F.max_by(F.struct("to_url", "status_code"), F.struct("rank", "position", "to_url")).alias("x")).select("project_id", "source", F.col("x.to_url").alias("target"), F.col("x.status_code").alias("code"))


def walk(starts: DataFrame, hops: DataFrame, most: int = HOPS) -> DataFrame:
    """``starts`` (project_id, page, code, to) with hops, an array of (source, target, code), and loop.

    The first hop is the page's own. Up to ``most`` more are looked up, each from where the last one led; the first whose source was visited before is added and ends a loop.
    """
    hop = lambda source, target, code: F.struct(source.alias("source"), target.alias("target"), code.cast("int").alias("code"))
    now = starts.withColumns({"hops": F.array(hop(F.col("page"), F.col("to"), F.col("code"))), "seen": F.array(U.normalize(F.col("page"))), "at": U.normalize(F.col("to")), "loop": F.lit(False)})
    step = hops.select("project_id", F.col("source").alias("at"), F.col("target").alias("next_to"), F.col("code").alias("next_code"))
    for _ in range(most):
        going = F.col("next_to").isNotNull() & ~F.col("loop")
        again = going & F.array_contains("seen", F.col("at"))
        address = F.element_at("hops", -1)["target"]
        now = now.join(step, ["project_id", "at"], "left").select(
            *starts.columns, F.when(going, F.concat("hops", F.array(hop(address, F.col("next_to"), F.col("next_code"))))).otherwise(F.col("hops")).alias("hops"), F.when(going & ~again, F.concat("seen", F.array("at"))).otherwise(F.col("seen")).alias("seen"),
            F.when(going & ~again, U.normalize(F.col("next_to"))).alias("at"), (F.col("loop") | F.coalesce(again, F.lit(False))).alias("loop"),
        )
    return now.drop("at", "seen")


def script_targets() -> Column:
    """The first plausible target of a redirect by script on a page."""
    code = lambda s: F.regexp_replace(F.regexp_replace(s["body"], r"(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")
    found = F.transform("scripts", lambda s: F.regexp_extract(code(s), r"(?i)(?:window\.)?location(?:\.(?:href|replace|assign))?\s*[=(]\s*[\"'`]([^\"'`\s]+)[\"'`]", 1))
    low = F.lower
    fine = lambda u: (F.length(u) >= 3) & ~low(u).rlike(r"\{\{|\}\}|\$\{|^javascript:|^about:blank$|undefined|null|^#/|^#$") & (u.rlike(r"^(https?://|//|/|\./)") | u.contains("."))
    return F.get(F.filter(found, fine), F.lit(0))


#: What each redirect code means.
SUMMARIES = {301: "passes signals on to the new address", 302: "for short moves, the old address stays indexed", 303: "follow up with GET, as after forms", 307: "temporary, keeps the method", 308: "permanent, keeps the method"}


def redirects(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    hops, known = hop_map(crawl), statuses(crawl)
    own = ctx.where("internal").withColumn("norm", U.normalize(F.col("page")))
    own = own.join(hops.select("project_id", F.col("source").alias("norm"), F.col("target").alias("hop_target"), "code"), ["project_id", "norm"], "left")
    own = own.withColumn("target", F.coalesce(U.resolve(F.col("page"), F.col("redirect_target")), F.col("hop_target"))).withColumn("target_norm", U.normalize(F.col("target")))
    own = own.join(known.withColumnRenamed("norm", "target_norm"), ["project_id", "target_norm"], "left")
    own = own.withColumns({"js": F.when(F.col("has_html"), script_targets()), "is_loop": F.coalesce("is_redirect_loop", F.lit(False)), "three": F.col("http_status").between(300, 399)})
    source, target, status, has = F.col("page"), F.col("target"), F.col("http_status"), F.col("target").isNotNull()
    moved = F.col("three") & ~F.col("is_loop") & has
    s, t = U.scheme(source), U.scheme(target)
    a, b = U.host(source), U.host(target)
    temporary = status.isin(302, 307)
    slash = (F.regexp_replace(source, "/+$", "") == F.regexp_replace(target, "/+$", "")) & (source.endswith("/") != target.endswith("/"))
    age = F.regexp_extract(F.coalesce(header("cache-control"), F.lit("")), r"(?i)max-age=(\d+)", 1).try_cast("long")
    summary = F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in SUMMARIES.items()), F.lit("an uncommon code, check that it is meant"))
    r = lambda when, issue, severity, to=target: rule(when, issue, severity, "", Source=source, Target=to, StatusCode=status)
    page = rows(own, "Redirects", [
        rule(F.col("is_loop"), "Infinite redirect loop", ERROR, "", Source=source, Target="(Loop)", StatusCode=0),
        r(F.col("three") & ~F.col("is_loop") & ~has, "Redirect is missing a Location header", ERROR, F.lit("(missing location header)")),
        r(moved, F.concat(X.redirect_kind(status), F.lit(" - "), summary), INFO),
        r(moved & temporary, "Temporary redirect detected", WARNING),
        r(moved & (s == "https") & (t == "http"), "Redirect downgrades HTTPS to HTTP", ERROR),
        r(moved & (s == "http") & (t == "https"), "Redirect upgrades HTTP to HTTPS", INFO),
        r(moved & (a == F.concat(F.lit("www."), b)), "Redirect from www to apex domain", INFO),
        r(moved & (b == F.concat(F.lit("www."), a)), "Redirect from apex to www domain", INFO),
        r(moved & slash, "Trailing-slash redirect", INFO),
        r((status == 200) & F.col("refresh_target").isNotNull() & ~F.col("is_loop"), F.format_string("Meta refresh redirect (%ds delay)", F.coalesce("refresh_delay", F.lit(0))), WARNING, F.col("refresh_target")),
        r((status == 200) & F.col("js").isNotNull() & ~F.col("is_loop"), "JavaScript-based redirect", WARNING, F.col("js")),
        r(moved & (F.col("target_status") >= 400), F.format_string("Redirect target returns HTTP %d", F.col("target_status")), F.when(F.col("target_status") >= 500, ERROR).otherwise(WARNING)),
        r(moved & F.col("target_status").between(300, 399), "Redirect target itself redirects", WARNING),
        r(moved & temporary & (age > 86400), F.format_string("Temporary redirect cached for %d days", (age / 86400).cast("long")), WARNING),
    ])
    walked = walk(own.where(moved).select("project_id", "url_id", "page", F.col("http_status").alias("code"), F.col("target").alias("to")), hops)
    n = F.size("hops")
    last = F.element_at("hops", -1)
    story = F.concat(F.array_join(F.transform("hops", lambda h: F.concat(h["source"], F.lit(" ("), h["code"].cast("string"), F.lit(")"))), " -> "), F.lit(" -> "), last["target"])
    long = rows(walked, "Redirects", [
        rule(F.col("loop"), F.format_string("Redirect Loop (%d hops)", n), ERROR, story, Source=F.col("page"), Target=last["target"], StatusCode=last["code"]),
        rule(~F.col("loop") & (n >= 2), F.format_string("Redirect Chain (%d hops)", n), F.when(n >= 3, ERROR).otherwise(WARNING), story, Source=F.col("page"), Target=last["target"], StatusCode=last["code"]),
    ])
    return page.unionByName(long)


def canonical(crawl: Crawl, ctx: DataFrame, compat: bool = False) -> DataFrame:
    """``compat``: a canonical to a URL that was not crawled counts as HTTP 0."""
    own = ctx.where(F.coalesce(F.col("http_status").between(200, 399), F.lit(False)) & (F.col("has_html") | F.col("canonical_http").isNotNull())).withColumns({"c": F.col("canonical"), "me": U.comparable(F.col("page"))}).withColumns({"cc": U.comparable(F.col("c")), "c_norm": U.normalize(F.col("c"))})
    own = own.join(statuses(crawl).withColumnRenamed("norm", "c_norm"), ["project_id", "c_norm"], "left")
    edges = own.where("c is not null and cc != me").groupBy("project_id", F.col("me").alias("source")).agg(F.max_by("c", "url_id").alias("target"))
    follow = edges.select("project_id", F.col("source").alias("cc"), F.col("target").alias("second"))
    own = own.join(follow, ["project_id", "cc"], "left")
    c, status = F.col("c"), F.col("target_status")
    other, cross = F.col("cc") != F.col("me"), F.coalesce(U.is_external(F.col("page"), c), F.lit(False))
    wrong = F.when(status.isNull(), F.lit(compat) & ~cross).otherwise(status != 200)
    paged = F.col("page").rlike(r"(?i)[?&]page=\d+|[?&]p=\d+|/page/\d+/|/p\d+/")
    first = c.rlike(r"(?i)[?&]page=1($|&)|[?&]p=1($|&)|/page/1/") | ~c.rlike(r"/p|[?&]page=|[?&]p=")
    mismatch = U.normalize_with_query(F.col("canonical_html")) != U.normalize_with_query(F.col("canonical_http"))
    r = lambda when, issue, severity, state="": rule(when, issue, severity, "", CanonicalURL=F.coalesce(c, F.lit("")), Status=state)
    page = rows(own, "Canonical", [
        r(c.isNull() & (F.col("depth") <= 2), "Missing Canonical", INFO, "Info"),
        r(F.col("has_multiple_canonicals"), "Multiple Canonicals", ERROR, "Conflict"),
        r(cross, "Cross-Domain Canonical", WARNING, "External Domain"),
        r(other & ~cross, "Canonical to Other Page", INFO, "OK"),
        r(other & F.col("second").isNotNull() & (U.comparable(F.col("second")) != F.col("me")), F.concat(F.lit("Canonical Chain: "), c, F.lit(" → "), F.col("second")), WARNING, "Chain Detected"),
        r(c.isNotNull() & wrong, F.format_string("Canonical Target Error (HTTP %d)", F.coalesce(status, F.lit(0))), ERROR, F.format_string("HTTP %d", F.coalesce(status, F.lit(0)))),
        r(c.isNotNull() & F.col("robots_noindex"), "Canonical + Noindex Conflict", WARNING, "Conflicting Directives"),
        r(other & paged & first, "Pagination Canonical Issue", WARNING, "Points to Page 1"),
        r(mismatch, "Canonical HTML/HTTP Mismatch", WARNING, "Mismatch"),
        r(c.isNotNull() & F.col("http_status").between(300, 399), F.format_string("Canonical on Redirect (HTTP %d)", F.col("http_status")), WARNING, F.format_string("HTTP %d", F.col("http_status"))),
    ])
    hops = edges.select("project_id", "source", F.col("target"), F.lit(0).alias("code"))
    starts = own.where(other).select("project_id", "url_id", "page", "c", F.col("me").alias("start"))
    walked = loops(starts, hops)
    return page.unionByName(rows(walked, "Canonical", [rule(F.col("loop"), F.concat(F.lit("Canonical Loop: "), F.array_join("path", " → ")), ERROR, "", CanonicalURL=F.col("c"), Status="Loop Detected")]))


def loops(starts: DataFrame, edges: DataFrame, most: int = HOPS) -> DataFrame:
    """``starts`` (…, page, start) with path, the addresses as written, and loop: edges between comparable URLs are followed until one leads to a URL seen before."""
    now = starts.withColumns({"path": F.array("page"), "seen": F.array("start"), "at": F.col("start"), "loop": F.lit(False)})
    step = edges.select("project_id", F.col("source").alias("at"), F.col("target").alias("written"), U.comparable(F.col("target")).alias("following"))
    for _ in range(most):
        going = F.col("following").isNotNull() & ~F.col("loop")
        again = going & F.array_contains("seen", F.col("following"))
        longer = lambda c, x: F.when(going, F.concat(c, F.array(x))).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        now = now.join(step, ["project_id", "at"], "left").select(*starts.columns, longer("path", "written"), longer("seen", "following"), F.when(going & ~again, F.col("following")).alias("at"), (F.col("loop") | F.coalesce(again, F.lit(False))).alias("loop"))
    return now.drop("at", "seen")


GENERIC = ["click here", "here", "learn more", "link", "more", "read more"]


def internal_edges(ctx: DataFrame) -> DataFrame:
    """(project_id, from_id, from_page, to_norm, to_url, anchor) of anchors to exactly the page's host."""
    own = ctx.select("project_id", "url_id", "page", F.explode("anchors").alias("a")).where(~F.col("a.href").rlike(r"(?i)^(javascript:|mailto:|tel:|#)"))
    return own.where(U.same_host_exactly(F.col("page"), F.col("a.url"))).select("project_id", F.col("url_id").alias("from_id"), F.col("page").alias("from_page"), U.normalize(F.col("a.url")).alias("to_norm"), F.col("a.url").alias("to_url"), F.col("a.text").alias("anchor"), F.col("a.at").alias("at"))


def internal_linking(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    own = standard(ctx).withColumn("norm", U.normalize(F.col("page")))
    edges = internal_edges(own)
    out = edges.groupBy("project_id", F.col("from_id").alias("url_id")).agg(F.count("*").alias("n_out"))
    blank = F.trim("anchor") != ""
    into = edges.where(F.col("to_norm") != U.normalize(F.col("from_page"))).groupBy("project_id", F.col("to_norm").alias("norm")).agg(F.count("*").alias("n_in"), F.count_if(blank).alias("n_named"), F.count_if(blank & F.lower(F.trim("anchor")).isin(GENERIC)).alias("n_generic"))
    counted = own.join(out, ["project_id", "url_id"], "left").join(into, ["project_id", "norm"], "left").fillna(0, ["n_out", "n_in", "n_named", "n_generic"])
    shared = {"Inlinks": F.col("n_in"), "Outlinks": F.col("n_out"), "Depth": F.col("depth")}
    r = lambda when, issue, severity, **more: rule(when, issue, severity, "", **({"FromURL": F.col("page"), "ToURL": "", "AnchorText": ""} | more), **shared)
    page = rows(counted, "InternalLinking", [
        r(F.col("n_out") == 0, "No Outlinks", INFO),
        r(F.col("n_out").between(1, 2) & (F.col("depth") <= 2), "Few Outlinks", INFO),
        r((F.col("n_in") == 0) & (F.col("depth") > 1) & (U.path(F.col("page")) != "/"), "Orphan Page", WARNING),
    ])
    worst = counted.where("n_generic > 0.5 * n_named").select("project_id", "norm", "url_id", "page", "depth", "n_in", "n_out")
    generic = edges.where(blank & F.lower(F.trim("anchor")).isin(GENERIC)).withColumnRenamed("to_norm", "norm").join(worst, ["project_id", "norm"])
    first = generic.withColumn("_n", F.row_number().over(Window.partitionBy("url_id").orderBy("from_page", "at", "from_id"))).where("_n <= 10")
    return page.unionByName(rows(first, "InternalLinking", [r(F.lit(True), "Generic Anchor", INFO, FromURL=F.col("from_page"), ToURL=F.col("page"), AnchorText=F.col("anchor"))]))


def orphans(ctx: DataFrame) -> DataFrame:
    """Pages without a link from another page, as an anti-join."""
    own = standard(ctx).withColumn("norm", U.normalize(F.col("page")))
    linked = internal_edges(own).where(F.col("to_norm") != U.normalize(F.col("from_page"))).select("project_id", F.col("to_norm").alias("norm")).distinct()
    return own.where((F.col("depth") > 1) & (U.path(F.col("page")) != "/")).join(linked, ["project_id", "norm"], "left_anti")


def outgoing(ctx: DataFrame) -> DataFrame:
    """(… link_url, link_text, link_type, anchor_id, nofollow, at) of all links that are checked, fragments of the own page as anchors."""
    keep = lambda u: (u != "") & ~u.rlike(r"^(javascript:|mailto:|tel:)")
    s = lambda url, text, kind, anchor, nofollow, at: F.struct(url.alias("url"), text.alias("text"), F.lit(kind).alias("type"), anchor.alias("anchor_id"), nofollow.alias("nofollow"), at.alias("at"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    links = F.transform(F.filter("anchors", lambda a: keep(a["href"]) & ~a["href"].startswith("#")), lambda a: s(a["url"], a["text"], "hyperlink", none, F.lower(a["rel"]).contains("nofollow"), a["at"]))
    marks = F.transform(F.filter("anchors", lambda a: a["href"].startswith("#") & (F.length(a["href"]) > 1)), lambda a: s(F.concat(F.col("page"), a["href"]), a["text"], "anchor", F.substring(a["href"], 2, 10000), F.lower(a["rel"]).contains("nofollow"), a["at"]))
    pictures = F.transform(F.filter("images", lambda i: (i["src"] != "") & ~i["src"].startswith("data:")), lambda i: s(i["url"], i["alt"], "image", none, no, i["at"]))
    sheets = F.transform(F.filter("stylesheets", lambda x: ~x["href"].startswith("data:")), lambda x, i: s(x["url"], F.lit(""), "stylesheet", none, no, i))
    code = F.transform(F.filter("scripts", lambda x: F.coalesce(x["src"] != "", F.lit(False)) & ~F.coalesce(x["src"], F.lit("")).startswith("data:")), lambda x, i: s(x["url"], F.lit(""), "script", none, no, i))
    return ctx.select("project_id", "url_id", "page", "ids", F.explode(F.concat(links, marks, pictures, sheets, code)).alias("l")).select("project_id", "url_id", "page", "ids", "l.*")


def broken_links(crawl: Crawl, ctx: DataFrame, agent: str = "") -> DataFrame:
    own = ctx.where(F.col("has_html") & ok())
    links = outgoing(own).withColumns({"external": U.is_external(F.col("page"), F.col("url")), "norm": U.normalize(F.col("url"))})
    outer = crawl.external_status.groupBy("url").agg(F.max_by(F.struct("status", "response_seconds", "failure"), F.when(F.col("user_agent") == agent, 1).otherwise(0)).alias("x"))
    checked = links.join(statuses(crawl), ["project_id", "norm"], "left").join(outer, "url", "left")
    checked = checked.withColumns({"code": F.when(F.col("external"), F.col("x.status")).otherwise(F.col("target_status")), "slow": F.col("external") & (F.col("x.response_seconds") > 5) & F.col("x.status").between(200, 299)})
    code, kind, anchor = F.col("code"), F.initcap("type"), F.col("type") == "anchor"
    found = lambda name, severity: F.struct(text(name).alias("issue"), F.lit(severity).alias("severity"))
    issue = (
        F.when(anchor, F.when(~F.array_contains("ids", F.col("anchor_id")), found("Broken Anchor Link", WARNING)))
        .when(~F.col("external") & code.isNull(), found("Link Not Crawled", WARNING))
        .when(F.col("slow"), found("Slow External Link", INFO))
        .when(code == 0, found(F.concat(F.lit("Connection Failed ("), kind, F.lit(")")), WARNING))
        .when(code == 401, found("Authentication Required", INFO))
        .when(code == 403, found("Forbidden Link", INFO))
        .when(code == 405, found("Method Not Allowed", INFO))
        .when(code == 451, found("Unavailable for Legal Reasons", INFO))
        .when(code >= 400, found(F.concat(F.lit("Broken "), kind), ERROR))
        .when(~F.col("external") & code.between(300, 399), found("Link Points to Redirect", INFO))
    )
    nofollow = F.when((F.col("type") == "hyperlink") & ~F.col("external") & F.col("nofollow"), found("Nofollow on Internal Link", WARNING))
    found = checked.withColumn("f", F.explode(F.filter(F.array(issue, nofollow), lambda x: x.isNotNull())))
    once = found.groupBy("project_id", "url_id", "page", F.col("f.issue").alias("name"), F.col("f.severity").alias("severity"), "url", "type", "external", "code").agg(F.count("*").alias("n"), F.min_by("text", "at").alias("text"))
    return rows(once, "BrokenLinks", [rule(F.lit(True), F.col("name"), F.col("severity"), "", LinkedFrom=F.col("page"), BrokenLink=F.col("url"), Status=F.coalesce(F.col("code").cast("string"), F.lit("")), LinkText=F.col("text"), LinkType=F.initcap("type"), IsExternal=F.when(F.col("external"), "Yes").otherwise("No"), Occurrences=F.col("n"))])


FRIENDLY = {0: "hyperlink", 1: "image link", 2: "script", 3: "stylesheet", 4: "resource"}


def link_graph(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    """A row for each stored link of an internal page; an unknown target is ``Unknown``."""
    target = crawl.urls.select(F.col("url_id").alias("to_url_id"), F.col("address").alias("to"))
    own = ctx.where("internal").select("project_id", "url_id", "page")
    edges = crawl.links.select(F.col("from_url_id").alias("url_id"), "to_url_id", "anchor_text", "link_type").join(own, "url_id").join(target, "to_url_id", "left")
    kind, anchor = X.labelled(F.col("link_type").cast("int"), LINK_TYPES, F.lit("Other")), F.trim(F.coalesce("anchor_text", F.lit("")))
    named = X.labelled(F.col("link_type").cast("int"), FRIENDLY, F.lit("resource"))
    issue = F.concat(F.lit("Internal "), named, F.when(anchor != "", " with anchor text").otherwise(" without anchor text"))
    return rows(edges, "LinkGraph", [rule(F.lit(True), issue, INFO, "", FromURL=F.col("page"), ToURL=F.coalesce("to", F.lit("Unknown")), AnchorText=F.when(anchor != "", anchor).otherwise("(no text)"), LinkType=kind)])


def reached(starts: DataFrame, edges: DataFrame, max_depth: int, max_urls: int) -> DataFrame:
    """Breadth-first crawl order over stored links: (address, depth) from ``starts`` (address), expanded below ``max_depth``; the first ``max_urls`` by depth and address."""
    visited = frontier = starts.select("address").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        frontier = edges.join(frontier.select(F.col("address").alias("source")), "source").select(F.col("target").alias("address")).distinct().join(visited, "address", "left_anti").withColumn("depth", F.lit(depth))
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited.orderBy("depth", "address").limit(max_urls)


def simulated(starts: DataFrame, edges: DataFrame, max_depth: int, max_urls: int, barred: DataFrame | None = None) -> DataFrame:
    """A crawl over known links: (address, depth, state) from ``starts`` (address) along ``edges`` (source, target, external).

    A page below ``max_depth`` is expanded; an external target is a leaf at depth -1; what ``barred`` (address) holds, as robots.txt forbids it, is seen but neither fetched nor expanded.
    Pages are taken by depth and address until ``max_urls`` are fetched; the rest stays queued. Each round is one join against what the last one found, and is checkpointed.
    """
    from siteloom.plans.lineage import checkpoint

    none = starts.select("address").limit(0)
    closed = barred.select("address").distinct() if barred is not None else none
    seen = layer = checkpoint(starts.select("address").distinct().withColumns({"depth": F.lit(0), "external": F.lit(False)}))
    for depth in range(1, max_depth + 1):
        open_pages = layer.where("not external").join(closed, "address", "left_anti").select(F.col("address").alias("source"))
        following = edges.join(open_pages, "source").groupBy(F.col("target").alias("address")).agg(F.min("external").alias("external")).join(seen.select("address"), "address", "left_anti")
        layer = checkpoint(following.select("address", F.when(F.col("external"), -1).otherwise(depth).alias("depth"), "external"))
        if layer.isEmpty():
            break
        seen = checkpoint(seen.unionByName(layer))
    fetched = seen.where("not external").join(closed, "address", "left_anti").orderBy("depth", "address").limit(max_urls).select("address", F.lit("fetched").alias("state"))
    kept = seen.join(fetched, "address", "left").join(closed.withColumn("closed", F.lit(True)), "address", "left")
    return kept.select("address", "depth", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("closed"), "barred").when(F.col("external"), "external").otherwise("queued").alias("state"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

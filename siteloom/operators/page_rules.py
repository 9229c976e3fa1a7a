"""Tasks whose rules look at one page: inventory, security, robots, titles, images, crawl budget, hreflang, structured data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.model import ERROR, INFO, WARNING, Crawl
from siteloom.operators.base import header, is_html, meta, ok, rows, rule, standard

#: Session parameters, the first that matches is reported: (pattern, name, example).
SESSIONS = [
    (r"[?&;]jsessionid=", "JSESSIONID (Java)", "jsessionid=ABC123"), (r"[?&]phpsessid=", "PHPSESSID (PHP)", "PHPSESSID=ABC123"), (r"[?&]sid=", "SID (PHP)", "sid=ABC123"),
    (r"[?&;(]aspsessionid[a-z]{8}=", "ASPSESSIONID (ASP.NET)", "ASPSESSIONID=ABC123"), (r"\(s\([a-z0-9]{24}\)\)", "ASP.NET Cookieless Session", "(S(abc123xyz))"), (r"[?&]cfid=", "CFID (ColdFusion)", "CFID=123456"),
    (r"[?&]cftoken=", "CFTOKEN (ColdFusion)", "CFTOKEN=ABC123"), (r"[?&]sessionid=", "SESSIONID (Generic)", "sessionid=ABC123"), (r"[?&]session_id=", "SESSION_ID (Generic)", "session_id=ABC123"), (r"[?&]sess=", "SESS (Generic)", "sess=ABC123"),
]


def named(n: Column, template: str) -> Column:
    return F.format_string(template, n)


def url_rules(url: Column) -> list[Column]:
    """INV1 to INV8: what a URL alone tells."""
    bare, q = F.regexp_replace(url, r"[?#].*$", ""), U.query(url)
    session = reduce(lambda c, s: c.when(url.rlike("(?i)" + s[0]), F.lit(f"{s[1]} parameter detected ({s[2]})")), SESSIONS[1:], F.when(url.rlike("(?i)" + SESSIONS[0][0]), F.lit(f"{SESSIONS[0][1]} parameter detected ({SESSIONS[0][2]})")))
    parts = F.size(F.split(F.substring(q, 2, 100000), "&"))
    has_query = q != ""
    return [
        rule(F.length(bare) > 100, "URL length > 100 characters (excluding query)", WARNING, "Shorten the URL."),
        rule((F.length(bare) > 75) & (F.length(bare) <= 100), "URL length > 75 characters (excluding query)", INFO, "Consider a shorter URL."),
        rule(url != F.lower(url), "Uppercase characters detected in URL", WARNING, "Mixed case makes duplicates of one page."),
        rule(has_query & (parts > 3), named(parts, "Too many query parameters (%d)"), INFO, "Many parameters multiply URLs."),
        rule(has_query & url.rlike(r"(?i)[?&](page|p|pg|offset|start)="), "Pagination parameter detected in URL", INFO, "Check that pages of a series are canonical."),
        rule(has_query & session.isNotNull(), session, ERROR, "Keep sessions out of URLs.", Indexable="No"),
        rule(url.rlike(r"[^a-zA-Z0-9\-_.~:/?#\[\]@!$&'()*+,;=%]"), "Special characters found in URL", INFO, "Percent-encode what is not safe."),
        rule(U.path(url).contains("_"), "Underscore detected in path", INFO, "Separate words by hyphens."),
    ]


def third_parties() -> Column:
    """Distinct hosts of scripts and style sheets that are not the page's own."""
    own, site = U.host(F.col("address")), U.bare_host(F.col("address"))
    found = F.concat(F.transform(F.filter("scripts", lambda s: U.is_absolute(F.coalesce(s["src"], F.lit("")))), lambda s: U.host(s["src"])), F.transform(F.filter("stylesheets", lambda s: U.is_absolute(s["href"])), lambda s: U.host(s["href"])))
    return F.array_distinct(F.filter(found, lambda h: (h != own) & ~h.contains(site)))


def inventory(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    own = ctx.where(F.col("internal") & is_html() & ok()).withColumn("n_third", F.size(F.coalesce(third_parties(), F.array().cast("array<string>"))))
    n, length, third = F.col("n_third"), F.length("body"), F.col("has_html")
    shared = {"ContentType": F.col("content_type"), "Status": F.col("http_status"), "Depth": F.col("depth"), "Indexable": F.when(F.col("is_indexable"), "Yes").otherwise("No")}
    found = rows(own, "Inventory", [
        *url_rules(F.col("address")),
        rule(third & (length < 900), "Very short content (<900 characters)", WARNING, "Thin pages rank poorly."),
        rule(third & length.between(900, 1799), "Limited content length (<1800 characters)", INFO, "Consider more substance."),
        rule(third & (n > 10), named(n, "More than 10 third-party domains (%d)"), WARNING, "Each domain costs connections."),
    ])
    details = own.select("url_id", F.create_map(*[c for k, v in shared.items() for c in (F.lit(k), v.cast("string"))]).alias("shared"))
    return found.join(details, "url_id").withColumn("fields", F.map_concat(F.map_filter("shared", lambda k, v: ~F.array_contains(F.map_keys("fields"), k)), "fields")).select(found.columns)


RESOURCE_NAMES = {"image": "Image", "script": "Script", "stylesheet": "Stylesheet", "iframe": "Iframe", "video": "Video", "audio": "Audio", "source": "Source", "object": "Object"}


def mixed_content() -> tuple[Column, Column]:
    """(how many plain HTTP resources, ``n Type(s)`` in order of first sight)."""
    bad = F.transform(F.filter("resources", lambda r: F.lower(r["url"]).startswith("http://")), lambda r: r["kind"])
    label = lambda k: X.labelled(k, RESOURCE_NAMES, k)
    listed = F.array_join(F.transform(F.array_distinct(bad), lambda k: F.concat(F.size(F.filter(bad, lambda b: b == k)).cast("string"), F.lit(" "), label(k), F.lit("(s)"))), ", ")
    return F.size(F.coalesce(bad, F.array().cast("array<string>"))), listed


def security_headers() -> tuple[Column, Column]:
    """(missing, weak) headers."""
    hsts, kind = header("strict-transport-security"), header("x-content-type-options")
    age = F.regexp_extract(hsts, r"(?i)max-age=(\d+)", 1).try_cast("long")
    lost = F.array_compact(F.array(F.when(hsts.isNull(), "Strict-Transport-Security"), F.when(header("content-security-policy").isNull() & header("content-security-policy-report-only").isNull(), "Content-Security-Policy"), F.when(kind.isNull(), "X-Content-Type-Options"), F.when(header("x-frame-options").isNull(), "X-Frame-Options"), F.when(header("referrer-policy").isNull(), "Referrer-Policy")))
    weak = F.array_compact(F.array(F.when(hsts.isNotNull() & (age.isNull() | (age < 31536000)), "Strict-Transport-Security"), F.when(kind.isNotNull() & (F.lower(kind) != "nosniff"), "X-Content-Type-Options")))
    return lost, weak


def cookies() -> Column:
    """Set-Cookie values without Secure or HttpOnly; a line with commas is several cookies unless it has ``; ``."""
    lines = F.flatten(F.transform(F.split(F.coalesce(header("set-cookie"), F.lit("")), "\n"), lambda v: F.when(v.contains("; "), F.array(v)).otherwise(F.split(v, ","))))
    return F.filter(lines, lambda c: (F.trim(c) != "") & ~(F.lower(c).contains("secure") & F.lower(c).contains("httponly")))


def security(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    n, listed = mixed_content()
    lost, weak = security_headers()
    secure = U.scheme(F.col("address")) == "https"
    own = standard(ctx).withColumns({"n_mixed": n, "mixed": listed, "lost": lost, "weak": weak, "bad_cookies": cookies(), "secure": secure})
    return rows(own, "Security", [
        rule(F.col("secure") & (F.col("n_mixed") > 0), named(F.col("n_mixed"), "Mixed Content (%d HTTP resources)"), ERROR, "Load every resource by HTTPS.", Protocol="HTTPS", Details=F.col("mixed")),
        rule(F.col("secure") & (F.size("lost") + F.size("weak") > 0), "Missing/Weak Security Headers", WARNING, F.concat(F.lit("Missing: "), F.array_join("lost", ", "), F.lit("; weak: "), F.array_join("weak", ", ")), Protocol="HTTPS", Details=F.format_string("%d missing, %d weak", F.size("lost"), F.size("weak"))),
        rule(F.size("bad_cookies") > 0, "Insecure Cookies", WARNING, "Set Secure and HttpOnly.", Protocol=F.upper(U.scheme(F.col("address"))), Details=named(F.size("bad_cookies"), "%d cookie(s)")),
        rule(~F.col("secure") & (F.col("depth") <= 2), "HTTP Instead of HTTPS", WARNING, "Serve important pages by HTTPS.", Protocol="HTTP", Details=""),
    ])


def robots(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    known = crawl.robots_txt.select(F.col("host").alias("robots_host")).distinct()
    start = ctx.where("internal").groupBy("project_id").agg(F.min_by("url_id", F.struct("depth", "url_id")).alias("start_id"))  # a site's first page
    own = ctx.where(F.col("internal")).withColumn("own_host", U.host(F.col("address"))).join(known, F.col("own_host") == F.col("robots_host"), "left").join(start, "project_id", "left").withColumns({"first": F.col("url_id") == F.col("start_id"), "html": is_html() & F.col("has_html"), "tag": F.lower(F.coalesce("x_robots_tag", F.lit("")))})
    html, tag, shallow = F.col("html"), F.col("tag"), F.col("depth") <= 2
    shared = {"RobotsMeta": F.coalesce("robots_meta", F.lit("")), "XRobotsTag": F.coalesce("x_robots_tag", F.lit("")), "Indexable": F.when(F.col("is_indexable"), "Yes").otherwise("No")}
    r = lambda when, issue, severity, why="": rule(when, issue, severity, why, **shared)
    grab = lambda pattern: F.regexp_extract(tag, pattern, 1)
    snippet, image, video = grab(r"max-snippet:\s*(-?\d+)"), grab(r"max-image-preview:\s*(none|standard|large)"), grab(r"max-video-preview:\s*(-?\d+)")
    why = F.when(F.col("robots_noindex") & F.col("x_robots_tag").isNotNull() & tag.rlike(r"\b(noindex|none)\b"), "X-Robots-Tag").otherwise("meta robots")
    return rows(own, "Robots", [
        r(F.col("first") & (F.col("depth") == 0) & F.col("robots_host").isNull(), "No robots.txt Found", INFO, "Crawlers look for one."),
        r(html & F.col("robots_noindex"), "Noindex Detected", F.when(shallow, WARNING).otherwise(INFO)),
        r(html & F.col("robots_nofollow"), "Nofollow Detected", INFO),
        r(tag != "", "X-Robots-Tag Present", INFO),
        r(F.col("robots_conflict"), "Conflicting Robots Directives", WARNING, "Meta and header disagree."),
        r(~F.col("is_indexable") & shallow, F.format_string("Important Page Not Indexable (Depth %d) - %s", F.col("depth"), why), WARNING),
        *(r(html & tag.contains(word), issue, INFO) for word, issue in (("noarchive", "Noarchive Directive"), ("nosnippet", "Nosnippet Directive"), ("noimageindex", "Noimageindex Directive"), ("unavailable_after", "Unavailable After Directive (Time-Limited)"), ("indexifembedded", "Indexifembedded Directive"))),
        r(html & (snippet != ""), F.concat(F.lit("Max-Snippet: "), snippet), F.when(snippet == "0", WARNING).otherwise(INFO)),
        r(html & (image != ""), F.concat(F.lit("Max-Image-Preview: "), image), F.when(image == "none", WARNING).otherwise(INFO)),
        r(html & (video != ""), F.concat(F.lit("Max-Video-Preview: "), video), F.when(video == "0", WARNING).otherwise(INFO)),
        r(html & tag.contains("googlebot-news"), "Googlebot-News Directive", INFO),
    ])


ACTIONS = "access browse buy check claim compare discover download explore find get grab join learn read save see shop start try unlock watch".split()


def titles(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    from siteloom.operators.dup_rules import shared_values

    blank = F.lit("")
    own = standard(ctx).withColumns({"t": F.trim(F.coalesce("title", blank)), "d": F.trim(F.coalesce(meta("description"), blank))})
    heads = lambda level: F.filter("headings", lambda h: h["level"] == level)
    own = own.withColumns({f"n_h{k}": F.size(heads(k)) for k in range(1, 7)} | {"h1": F.trim(F.coalesce(F.get(heads(1), F.lit(0))["text"], blank))})
    own = own.withColumns({"px": X.pixel_width(F.col("t")), "t_len": F.length("t"), "d_len": F.length("d"), "viewport": F.trim(F.coalesce(meta("viewport"), blank)), "charset": F.coalesce(F.get("charsets", F.lit(0)), blank)})
    own = own.withColumn("n_og", reduce(lambda a, b: a + b, (F.coalesce(meta(f"og:{x}"), blank).isNotNull().cast("int") * (F.coalesce(meta(f"og:{x}"), blank) != "").cast("int") for x in ("title", "description", "image", "url", "type"))))
    own = own.withColumn("n_tw", reduce(lambda a, b: a + b, ((F.coalesce(meta(f"twitter:{x}"), blank) != "").cast("int") for x in ("card", "title", "description", "image"))))
    t, d, tl, dl, px = (F.col(c) for c in ("t", "d", "t_len", "d_len", "px"))
    has_t, has_d, one = t != "", d != "", (F.col("n_h1") == 1)
    shared = {"Title": t, "MetaDescription": d}
    r = lambda when, issue, severity, length=None, why="": rule(when, issue, severity, why, Length=F.lit(0) if length is None else length, **shared)
    alike = X.jaccard(F.col("h1"), t)
    page = rows(own, "TitlesMeta", [
        r(~has_t, "Missing Title", ERROR),
        r(has_t & (tl < 30), "Title Too Short", WARNING, tl),
        r(tl > 70, "Title Too Long (Will Truncate)", WARNING, tl),
        r(tl.between(61, 70), "Title Long (May Truncate)", WARNING, tl),
        r(px > 600, named(px, "Title Pixel Width Exceeded (~%dpx)"), INFO, tl),
        r(px.between(581, 600), named(px, "Title May Truncate on Mobile (~%dpx)"), INFO, tl),
        r(~has_d, "Missing Meta Description", WARNING),
        r(has_d & (dl < 50), "Meta Description Too Short", WARNING, dl),
        r(dl > 200, "Meta Description Too Long (Will Truncate)", WARNING, dl),
        r(dl.between(161, 200), "Meta Description Long (May Truncate)", INFO, dl),
        r(has_d & ~F.lower(d).rlike(r"\b(" + "|".join(ACTIONS) + r")\b"), "Description Lacks Action Words", INFO, dl),
        r(has_t & ~t.rlike(r"[|\-•→–—\[\]():]"), "Title Lacks Visual Separators", INFO, tl),
        r(F.col("viewports") > 1, named(F.col("viewports"), "Multiple Viewport Declarations (%d)"), WARNING),
        r((F.col("viewports") <= 1) & (F.col("viewport") == ""), "Missing Viewport Meta Tag", WARNING),
        r(F.col("charset") == "", "Missing Charset Declaration", WARNING),
        r((F.col("charset") != "") & ~F.lower("charset").isin("utf-8", "utf8"), F.concat(F.lit("Non-UTF8 Charset ("), F.col("charset"), F.lit(")")), INFO),
        r(F.size("charsets") > 1, named(F.size("charsets"), "Multiple Charset Declarations (%d)"), WARNING),
        r(F.coalesce("html_lang", blank) == "", "Missing Lang Attribute", WARNING),
        r(F.col("n_og") == 0, "Missing Open Graph Tags", WARNING),
        r(F.col("n_og").between(1, 3), named(F.col("n_og"), "Incomplete Open Graph (%d/4)"), INFO),
        r(F.col("n_tw") == 0, "Missing Twitter Card Tags", INFO),
        r(F.col("n_h1") == 0, "Missing H1 Tag", ERROR),
        r(F.col("n_h1") > 1, named(F.col("n_h1"), "Multiple H1 Tags (%d)"), WARNING),
        r(one & (F.col("h1") == ""), "Empty H1 Tag", WARNING),
        r(one & (F.col("h1") != "") & (F.lower("h1") == F.lower(t)), "Identical H1 and Title", INFO),
        r(one & (F.col("h1") != "") & has_t & (F.lower("h1") != F.lower(t)) & (alike < 0.3), "H1 and Title Unrelated", INFO),
        r((F.col("n_h2") == 0) & (F.col("n_h3") + F.col("n_h4") + F.col("n_h5") + F.col("n_h6") > 0), "Heading Hierarchy Skips H2", INFO),
        r((F.col("n_h2") > 0) & (F.col("n_h3") == 0) & (F.col("n_h4") + F.col("n_h5") + F.col("n_h6") > 0), "Heading Hierarchy Skips H3", INFO),
        r(meta("keywords").isNotNull(), "Meta Keywords Tag Found (Outdated)", INFO),
    ])
    return page.unionByName(shared_values(crawl, own))


def image_rules(page: Column, i: Column) -> list[Column]:
    """What one image of a page tells."""
    src, alt, title = (F.coalesce(i[c], F.lit("")) for c in ("src", "alt", "title"))
    w, h = i["width"], i["height"]
    data = F.lower(src).startswith("data:")
    url = F.when(data, X.preview(src, 100)).otherwise(i["url"])
    ext = F.lower(U.extension(i["url"]))
    legacy, external = ext.isin(".jpg", ".jpeg", ".png"), U.is_external_image(page, i["url"])
    r = lambda when, issue, severity, key="", size=None: rule(when, issue, severity, "", ImageURL=url, AltText=alt, FileSize=F.lit(None) if size is None else size, Key=key)
    real, size = (src != "") & ~data, (F.length(src) * 3 / 4).cast("int")
    named_alt = (src != "") & (F.trim(alt) != "") & ~data
    decorative = F.lower(i["url"]).rlike("icon|spacer|divider|bullet") | F.lower(alt).rlike("decorative|spacer|decoration")
    return [
        r(src == "", "Missing Image Source", ERROR),
        r(real & (w.isNull() | h.isNull()), "Missing Image Dimensions", WARNING),
        r(real & (F.lower(F.coalesce(i["loading"], F.lit(""))) != "lazy") & ((F.coalesce(w, F.lit(0)).cast("long") * F.coalesce(h, F.lit(0)) > 50000) | (w.isNull() & h.isNull())), "Missing Lazy Loading", INFO),
        r(real & (F.trim(i["srcset"]) == "") & ~external & legacy & (w > 400), "Missing Responsive Images", INFO),
        r(real & legacy & ~external, "Legacy Image Format", INFO),
        r(real & external, "External Image Hotlink", INFO),
        r(real & (ext == ".svg") & (w.isNotNull() | h.isNotNull()), "SVG with Pixel Dimensions", INFO, F.concat_ws("|", w, h)),
        r((src != "") & ~data & (F.trim(alt) == ""), "Missing Alt Text", WARNING),
        r(named_alt & (F.length(alt) < 5) & ~alt.isin("*", "-", "·"), "Alt Text Too Short", INFO, alt),
        r(named_alt & (F.length(alt) > 125), "Alt Text Too Long", WARNING, F.substring(alt, 1, 100)),
        r(named_alt & decorative, "Potentially Decorative Image", INFO, alt),
        r(named_alt & (F.trim(title) != "") & (F.lower(title) == F.lower(alt)), "Redundant Title Attribute", INFO, alt),
        r(named_alt & alt.rlike(r"(?i)^(image|picture|photo|img|graphic)(\s+of)?"), "Alt Text Bad Pattern", INFO, alt),
        r(data & ((size / 1024).cast("int") > 10), named((size / 1024).cast("int"), "Large Data URI (%dKB)"), WARNING, "", size),
    ]


def images(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    """A page's images are judged and repeated findings (one for each image and kind, the first) dropped within the page's own array, so that nothing is shuffled."""
    own = ctx.where(ok() & F.col("internal") & F.col("has_html"))
    every = F.flatten(F.transform("images", lambda i: F.filter(F.array(*image_rules(F.col("page"), i)), lambda x: x.isNotNull())))
    key = lambda x: F.concat_ws("\n", x["issue"], x["fields"]["ImageURL"], x["fields"]["Key"])
    own = own.select("project_id", F.lit("ImageAudit").alias("task_key"), "url_id", "page", every.alias("every")).withColumn("keys", F.transform("every", key))
    first = F.filter("every", lambda x, k: F.array_position("keys", key(x)) == k + 1)
    found = own.select("project_id", "task_key", "url_id", "page", F.explode(first).alias("f")).select("project_id", "task_key", "url_id", "page", "f.issue", "f.severity", "f.explanation", "f.fields")
    return found.withColumn("fields", F.map_filter("fields", lambda k, v: k != "Key"))


MISSING_PAGE = sorted(["404", "coming soon", "has been deleted", "has been removed", "no items found", "no longer exists", "no results found", "not found", "nothing found", "oops! that page can", "page could not be found", "page does not exist", "page doesn't exist", "page not found", "sorry, but nothing matched", "the page you are looking for", "the page you requested", "under construction"], key=len)


def crawl_budget(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    place = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    h1 = F.lower(F.coalesce(F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"], F.lit("")))
    matches = reduce(lambda a, b: a + b, (p.contains(w).cast("int") for w in MISSING_PAGE for p in (place("title"), h1, F.substring(place("body"), 1, 500))))
    own = ctx.where(F.col("internal")).withColumns({"matches": F.when(F.col("has_html") & ok(), matches).otherwise(0), "size": F.length(F.coalesce("body", F.lit("")))})
    soft = F.col("has_html") & ok() & ((F.col("matches") > 0) | ((F.col("size") < 200) & place("title").rlike("error|not found")))
    sure = F.when((F.col("matches") == 1) & (F.col("size") > 500), "medium").otherwise("high")
    shared = {"StatusCode": F.col("http_status"), "Depth": F.col("depth")}
    page = rows(own, "CrawlBudget", [
        rule(F.col("http_status").between(500, 599), named(F.col("http_status"), "Server Error (HTTP %d)"), WARNING, "Crawlers slow down on server errors.", Details="", **shared),
        rule(soft, F.concat(F.lit("Soft 404 ("), sure, F.lit(" confidence)")), WARNING, "Answer with a real status.", Details="", **shared),
    ])
    rate = ctx.where(F.col("internal") & F.col("http_status").isNotNull()).groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("http_status").between(500, 599)).alias("bad"), F.min("base_url").alias("page")).withColumn("url_id", F.lit(None).cast("long"))
    share = F.col("bad") / F.col("n") * 100
    high = rows(rate, "CrawlBudget", [rule((F.col("n") >= 50) & (share > 5), F.format_string("High Server Error Rate (%d%%)", share.cast("int")), ERROR, "", Details=F.format_string("%d of %d pages", "bad", "n"), StatusCode=F.lit(None), Depth=F.lit(None))])
    return page.unionByName(high)


LANGUAGES = "ar bg bn ca cs da de el en es et fa fi fr he hi hr hu id is it ja ko lt lv ms nb nl nn no pl pt ro ru sk sl sr sv sw ta te th tr uk ur vi zh".split()
REGIONS = "AE AR AT AU BE BG BH BO BR CA CH CL CN CO CR CY CZ DE DK DO DZ EC EE EG ES FI FR GB GR GT HK HN HR HU ID IE IL IN IS IT JO JP KR KW LB LT LU LV LY MA MT MX MY NI NL NO NZ OM PA PE PH PL PR PT PY QA RO RS RU SA SD SE SG SI SK SV TH TN TR TW UA US UY VE VN ZA".split()


def alternates(ctx: DataFrame) -> DataFrame:
    """(project_id, url_id, page, code, target, source) of HTML and Link-header alternates."""
    html = F.transform("alternates", lambda a: F.struct(a["code"].alias("code"), a["url"].alias("target"), F.lit("HTML").alias("source")))
    raw = F.split(F.coalesce(header("link"), F.lit("")), r",(?=\s*<)")
    http = F.transform(F.filter(raw, lambda x: F.lower(x).contains("hreflang=")), lambda x: F.struct(F.regexp_extract(x, r"(?i)hreflang=[\"']?([^\"';\s]+)", 1).alias("code"), U.resolve(F.col("page"), F.regexp_extract(x, r"<([^>]+)>", 1)).alias("target"), F.lit("HTTP Header").alias("source")))
    return ctx.select("project_id", "url_id", "page", "canonical", F.explode(F.concat(html, http)).alias("x")).select("project_id", "url_id", "page", "canonical", "x.*")


def hreflang(crawl: Crawl, ctx: DataFrame, compat: bool = False) -> DataFrame:
    """``compat``: regions are tested after lower-casing the code, so that every valid region is flagged."""
    tags = alternates(standard(ctx)).withColumn("code_lower", F.lower("code"))
    parts = F.split(F.col("code_lower") if compat else F.col("code"), "-")
    region = F.get(parts, F.lit(1))
    bad_region = region.isNotNull() & ((F.length(region) != 2) | ~F.upper(region).isin(REGIONS) | (region != F.upper(region)))
    bad_language = ~F.lower(parts[0]).isin(LANGUAGES)
    errors = F.when(F.col("code_lower") == "x-default", 0).when(bad_language, 1).otherwise(bad_region.cast("int") + (F.size(parts) > 2).cast("int"))
    norm_self, norm_to = U.normalize(F.col("page")), U.normalize(F.col("target"))
    per = tags.withColumns({"errors": errors, "to": norm_to, "self": norm_self}).groupBy("project_id", "url_id", "page").agg(
        F.sum("errors").alias("n_bad"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("errors") > 0, F.col("code")))), 1, 3), ", ").alias("bad"),
        F.max(F.col("to") == F.col("self")).alias("has_self"), F.collect_list("code_lower").alias("codes"), F.max(F.col("code_lower") == "x-default").alias("has_default"),
        F.collect_set(F.when(F.col("source") == "HTML", F.concat_ws("|", "code_lower", "to"))).alias("html"), F.collect_set(F.when(F.col("source") != "HTML", F.concat_ws("|", "code_lower", "to"))).alias("http"),
        F.max(U.comparable(F.col("canonical")) != U.comparable(F.col("page"))).alias("other_canonical"), F.min("target").alias("target"),
    )
    doubled = F.filter(F.array_sort(F.array_distinct("codes")), lambda c: F.size(F.filter("codes", lambda x: x == c)) > 1)
    listed = F.array_join(F.transform(doubled, lambda c: F.concat(c, F.lit(" ("), F.size(F.filter("codes", lambda x: x == c)).cast("string"), F.lit("x)"))), ", ")
    differ = (F.size("html") > 0) & (F.size("http") > 0) & ((F.size(F.array_except("html", "http")) > 0) | (F.size(F.array_except("http", "html")) > 0))
    every = F.array_join(F.array_sort(F.array_distinct("codes")), ", ")
    page = rows(per, "Hreflang", [
        rule(F.col("n_bad") > 0, named(F.col("n_bad"), "Invalid Hreflang Syntax (%d tags)"), ERROR, "", HreflangTag=F.col("bad"), TargetURL=F.col("target")),
        rule(~F.col("has_self"), "Missing Self-Referencing Hreflang", ERROR, "", HreflangTag=every, TargetURL=F.col("page")),
        rule(F.size(doubled) > 0, "Duplicate Hreflang Codes", ERROR, "", HreflangTag=listed, TargetURL=F.col("target")),
        rule((F.size(F.array_distinct("codes")) > 2) & ~F.col("has_default"), "Missing x-default Hreflang", WARNING, "", HreflangTag=every, TargetURL=F.col("target")),
        rule(differ, "HTML/HTTP Hreflang Mismatch", WARNING, "", HreflangTag=every, TargetURL=F.col("target")),
        rule(F.col("other_canonical"), "Hreflang/Canonical Conflict", WARNING, "", HreflangTag=every, TargetURL=F.col("target")),
    ])
    pairs = tags.select("project_id", "url_id", "page", norm_self.alias("self"), norm_to.alias("to")).where("self != to").distinct()
    known = pairs.select("project_id", F.col("self").alias("to")).distinct()
    back = pairs.select("project_id", F.col("to").alias("self"), F.col("self").alias("to")).distinct()
    lost = pairs.join(known, ["project_id", "to"], "left_semi").join(back, ["project_id", "self", "to"], "left_anti").groupBy("project_id", "url_id", "page").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    return page.unionByName(rows(lost, "Hreflang", [rule(F.lit(True), named(F.col("n"), "Missing Bidirectional Links (%d targets)"), ERROR, "", HreflangTag="", TargetURL=F.col("to"))]))

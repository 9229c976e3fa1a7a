"""The sixteen tasks as queries over the planted crawl, with SQL that tells their findings from the planted columns alone.

A query runs the registered task on parsed markup; its SQL never sees markup, only what was planted, and states each rule by its own words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.model import PRIORITY
from siteloom.operators import base, dup_rules, graph_rules, page_rules, registry, site_rules
from siteloom.plans import audit
from siteloom.sources import lookups, planted

#: Of each task the report columns that a query shows beside its issue.
DETAIL = {
    "Inventory": ["Indexable"], "Security": ["Details"], "Robots": ["Indexable"], "Redirects": ["Target", "StatusCode"], "Canonical": ["Status", "CanonicalURL"], "TitlesMeta": ["Length"], "Hreflang": ["HreflangTag"], "InternalLinking": ["AnchorText", "Inlinks", "Outlinks"],
    "Sitemap": ["InSitemap"], "DuplicateContent": ["Similarity"], "BrokenLinks": ["BrokenLink", "LinkType", "Occurrences"], "CrawlBudget": ["Details"], "ImageAudit": ["ImageURL", "AltText"], "StructuredData": ["Property"], "CustomExtraction": ["ExtractedValue"], "LinkGraph": ["ToURL", "AnchorText"],
}


def task(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url_id, issue, severity, detail) of one task's findings, -1 for the URL of a whole site's; the parser's own words are cut from syntax errors."""
    found = registry.default().run(planted.crawl(spark, sf_dir), [key])
    detail = F.concat_ws("|", *(F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")) for c in DETAIL[key]))
    broken = F.col("issue").startswith("JSON Syntax Error")
    return found.select(F.coalesce("url_id", F.lit(-1)).alias("url_id"), F.when(broken, "JSON Syntax Error").otherwise(F.col("issue")).alias("issue"), "severity", F.when(broken, "").otherwise(detail).alias("detail"))


def extraction_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values by page and rule."""
    crawl = planted.crawl(spark, sf_dir)
    return site_rules.pivot(registry.default().run(crawl, ["CustomExtraction"]), crawl.extraction_rules)


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a link from another page, by an anti-join."""
    return graph_rules.orphans(base.pages(planted.crawl(spark, sf_dir))).select("url_id", "page", "depth")


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the parser finds, by type and flags."""
    found = lookups.links(base.pages(planted.crawl(spark, sf_dir)))
    return found.groupBy("project_id", "link_type", "is_nofollow").agg(F.count("*").alias("links"), F.count_distinct("norm").alias("targets"))


def copies_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates as pages arrive one after another."""
    crawl = planted.crawl(spark, sf_dir)
    found = dup_rules.exact_on_arrival(crawl, base.pages(crawl))
    return found.where("url_id is not null and startswith(issue, 'Exact')").select("url_id", "issue", "severity")


QUERIES: dict[str, Callable] = {f"task_{k.lower()}": partial(task, k) for k in PRIORITY} | {f.__name__: f for f in (extraction_pivot, orphan_pages, link_table, copies_on_arrival)}

X0 = ", ".join(f"{sql} AS {name}" for name, sql in planted.COLUMNS.items() if name != "k")
OUTS = "CASE WHEN outs > 0 THEN anchor ELSE '' END || CASE WHEN outs > 1 THEN 'Page about shipsElsewhereUp' ELSE '' END"
FIRST_H1 = "CASE WHEN n_h1 = 2 THEN 'One heading' ELSE h1 END"
WITH = f"""WITH k0 AS (SELECT page_id AS k FROM pages), x0 AS (SELECT k, {X0}, CASE WHEN {planted.status('k')} IN (301, 302) THEN {planted.TARGET} END AS target FROM k0),
x1 AS (SELECT *, {planted.DERIVED['para']} AS para FROM x0),
x AS (SELECT *, kind LIKE 'text/html%' AS html, status BETWEEN 200 AND 299 AS ok, NOT ext AS internal, kind LIKE 'text/html%' AND robots IN ('noindex', 'none') OR x_robots = 'noindex' AS noindex,
trim(CASE n_h1 WHEN 2 THEN 'One headingTwo heading' WHEN 1 THEN h1 ELSE '' END || repeat('Part', n_h2) || repeat('Section', n_h3) || repeat('Item', n_h4) || para || {OUTS}) AS body,
CASE WHEN kind LIKE 'text/html%' AND n_canon > 0 THEN canon WHEN k % 21 = 6 THEN 'https://www.s0.example.org/canonical' END AS c FROM x1),
std AS (SELECT * FROM x WHERE html AND ok AND internal)
"""


def union(rows: list[str]) -> str:
    """Of (condition, issue, severity, detail) over a relation."""
    return " UNION ALL ".join(rows)


def rule(when: str, issue: str, severity: str | int, detail: str = "''", source: str = "std", url: str = "k") -> str:
    return f"SELECT {url} AS url_id, {issue} AS issue, CAST({severity} AS INTEGER) AS severity, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {when}"


YES = "CASE WHEN noindex THEN 'No' ELSE 'Yes' END"
BARE = "regexp_replace(address, '[?#].*$', '')"
inventory = [rule(w, f"'{i}'", s, d) for w, i, s, d in (
    (f"length({BARE}) > 100", "URL length > 100 characters (excluding query)", 1, YES), (f"length({BARE}) BETWEEN 76 AND 100", "URL length > 75 characters (excluding query)", 2, YES), ("address <> lower(address)", "Uppercase characters detected in URL", 1, YES),
    ("k % 13 = 1", "Too many query parameters (4)", 2, YES), ("k % 13 = 1", "Pagination parameter detected in URL", 2, YES), ("k % 13 = 2", "SID (PHP) parameter detected (sid=ABC123)", 0, "'No'"), ("contains(address, '|')", "Special characters found in URL", 2, YES), ("k % 11 = 3", "Underscore detected in path", 2, YES),
    ("length(body) < 900", "Very short content (<900 characters)", 1, YES), ("length(body) BETWEEN 900 AND 1799", "Limited content length (<1800 characters)", 2, YES),
)]
SECURE = "starts_with(address, 'https:')"
MISSING = "(CASE WHEN hsts = '' THEN 1 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN nosniff = '' THEN 1 ELSE 0 END)"
WEAK = "(CASE WHEN hsts = 'max-age=100' THEN 1 ELSE 0 END + CASE WHEN nosniff = 'other' THEN 1 ELSE 0 END)"
security = [
    rule(f"{SECURE} AND insecure > 0", "'Mixed Content (' || insecure || ' HTTP resources)'", 0, "CASE insecure WHEN 1 THEN '1 Image(s)' ELSE '1 Image(s), 1 Iframe(s)' END"), rule(f"{SECURE} AND {MISSING} + {WEAK} > 0", "'Missing/Weak Security Headers'", 1, f"{MISSING} || ' missing, ' || {WEAK} || ' weak'"),
    rule("k % 6 IN (1, 2)", "'Insecure Cookies'", 1, "CASE k % 6 WHEN 1 THEN '1 cookie(s)' ELSE '2 cookie(s)' END"), rule(f"NOT {SECURE} AND depth <= 2", "'HTTP Instead of HTTPS'", 1),
]
SHALLOW = "CASE WHEN depth <= 2 THEN 1 ELSE 2 END"
robots = [rule(f"internal AND {w}", i, s, YES, "x") for w, i, s in (
    ("k IN (SELECT min(k) FROM x WHERE internal AND depth = 0 GROUP BY k % 4) AND k % 4 <> 0", "'No robots.txt Found'", 2), ("html AND noindex", "'Noindex Detected'", SHALLOW), ("html AND robots IN ('nofollow', 'none')", "'Nofollow Detected'", 2), ("x_robots <> ''", "'X-Robots-Tag Present'", 2),
    ("html AND robots <> '' AND x_robots <> '' AND NOT (robots = 'noindex' AND x_robots = 'noindex')", "'Conflicting Robots Directives'", 1), ("noindex AND depth <= 2", "'Important Page Not Indexable (Depth ' || depth || ') - ' || CASE WHEN x_robots = 'noindex' THEN 'X-Robots-Tag' ELSE 'meta robots' END", 1),
    ("html AND k % 18 = 2", "'Noarchive Directive'", 2), ("html AND k % 18 IN (2, 7)", "'Nosnippet Directive'", 2), ("html AND k % 18 = 6", "'Noimageindex Directive'", 2), ("html AND k % 18 = 5", "'Unavailable After Directive (Time-Limited)'", 2), ("html AND k % 18 = 5", "'Indexifembedded Directive'", 2),
    ("html AND k % 18 = 3", "'Max-Snippet: 0'", 1), ("html AND k % 18 = 4", "'Max-Image-Preview: large'", 2), ("html AND k % 18 = 4", "'Max-Video-Preview: -1'", 2), ("html AND k % 18 = 7", "'Googlebot-News Directive'", 2),
)]
KINDS = {301: ("Permanent Redirect (301)", "passes signals on to the new address"), 302: ("Temporary Redirect (302)", "for short moves, the old address stays indexed")}
HOSTS = audit.host("address"), audit.host("target")
REDIRECTS = f""", hops AS (SELECT project_id, norm, target, status FROM x WHERE target IS NOT NULL),
moved AS (SELECT x.*, s.status AS target_status FROM (SELECT *, {audit.norm('target')} AS to_norm FROM x WHERE internal AND target IS NOT NULL AND k % 100 <> 82) x LEFT JOIN x s ON s.project_id = x.project_id AND s.norm = x.to_norm),
walk AS (SELECT k, project_id, 1 AS n, to_norm AS at, [norm] AS seen, false AS loop, target AS last_to, status AS last_code FROM moved
UNION ALL SELECT w.k, w.project_id, w.n + 1, {audit.norm('h.target')}, list_append(w.seen, w.at), list_contains(w.seen, w.at), h.target, h.status FROM walk w JOIN hops h ON h.project_id = w.project_id AND h.norm = w.at WHERE w.n < 6 AND NOT w.loop),
ended AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS place FROM walk) WHERE place = 1)
"""
redirects = [rule(w, i, s, d, f) for w, i, s, d, f in (
    ("internal AND k % 100 = 82", "'Infinite redirect loop'", 0, "'(Loop)|0'", "x"), ("internal AND status IN (301, 302) AND target IS NULL AND k % 100 <> 82", "'Redirect is missing a Location header'", 0, "'(missing location header)|' || status", "x"),
    *((f"status = {c}", f"'{a} - {b}'", 2, "target || '|' || status", "moved") for c, (a, b) in KINDS.items()), ("status = 302", "'Temporary redirect detected'", 1, "target || '|302'", "moved"),
    (f"{SECURE} AND starts_with(target, 'http:')", "'Redirect downgrades HTTPS to HTTP'", 0, "target || '|' || status", "moved"), (f"NOT {SECURE} AND starts_with(target, 'https:')", "'Redirect upgrades HTTP to HTTPS'", 2, "target || '|' || status", "moved"),
    (f"{HOSTS[0]} = 'www.' || {HOSTS[1]}", "'Redirect from www to apex domain'", 2, "target || '|' || status", "moved"), (f"{HOSTS[1]} = 'www.' || {HOSTS[0]}", "'Redirect from apex to www domain'", 2, "target || '|' || status", "moved"),
    ("rtrim(address, '/') = rtrim(target, '/') AND (address LIKE '%/') <> (target LIKE '%/')", "'Trailing-slash redirect'", 2, "target || '|' || status", "moved"), ("internal AND html AND status = 200 AND refresh", "'Meta refresh redirect (3s delay)'", 1, "'/next|200'", "x"), ("internal AND html AND status = 200 AND script_to", "'JavaScript-based redirect'", 1, "'/moved|200'", "x"),
    ("target_status >= 400", "'Redirect target returns HTTP ' || target_status", "CASE WHEN target_status >= 500 THEN 0 ELSE 1 END", "target || '|' || status", "moved"), ("target_status BETWEEN 300 AND 399", "'Redirect target itself redirects'", 1, "target || '|' || status", "moved"), ("status = 302 AND max_age > 86400", "'Temporary redirect cached for 2 days'", 1, "target || '|302'", "moved"),
    ("loop", "'Redirect Loop (' || n || ' hops)'", 0, "last_to || '|' || last_code", "ended"), ("NOT loop AND n >= 2", "'Redirect Chain (' || n || ' hops)'", "CASE WHEN n >= 3 THEN 0 ELSE 1 END", "last_to || '|' || last_code", "ended"),
)]
OTHER = "c IS NOT NULL AND c <> address"
CROSS = f"regexp_replace({audit.host('o.address')}, '^www\\.', '') <> regexp_replace({audit.host('o.c')}, '^www\\.', '')"
CANONICAL = f""", own AS (SELECT * FROM x WHERE status BETWEEN 200 AND 399 AND (html OR k % 21 = 6)), edges AS (SELECT project_id, address AS source, c AS target FROM own WHERE {OTHER}),
y AS (SELECT o.*, COALESCE(o.c <> o.address, false) AS other, COALESCE({CROSS}, false) AS apart, e.target AS second, s.status AS c_status FROM own o LEFT JOIN edges e ON e.project_id = o.project_id AND e.source = o.c LEFT JOIN x s ON s.project_id = o.project_id AND s.norm = {audit.norm('o.c')})
"""
canonical = [rule(w, i, s, d, "y") for w, i, s, d in (
    ("c IS NULL AND depth <= 2", "'Missing Canonical'", 2, "'Info|'"), ("html AND n_canon > 1", "'Multiple Canonicals'", 0, "'Conflict|' || c"), ("apart", "'Cross-Domain Canonical'", 1, "'External Domain|' || c"), ("other AND NOT apart", "'Canonical to Other Page'", 2, "'OK|' || c"),
    ("other AND second IS NOT NULL AND second <> address", "'Canonical Chain: ' || c || ' → ' || second", 1, "'Chain Detected|' || c"), ("c_status <> 200", "'Canonical Target Error (HTTP ' || c_status || ')'", 0, "'HTTP ' || c_status || '|' || c"), ("c IS NOT NULL AND noindex", "'Canonical + Noindex Conflict'", 1, "'Conflicting Directives|' || c"),
    ("other AND k % 13 = 1 AND NOT contains(c, '/p')", "'Pagination Canonical Issue'", 1, "'Points to Page 1|' || c"), ("html AND n_canon > 0 AND k % 21 = 6", "'Canonical HTML/HTTP Mismatch'", 1, "'Mismatch|' || c"), ("c IS NOT NULL AND status BETWEEN 300 AND 399", "'Canonical on Redirect (HTTP ' || status || ')'", 1, "'HTTP ' || status || '|' || c"),
    ("other AND second = address", "'Canonical Loop: ' || address || ' → ' || c || ' → ' || second", 0, "'Loop Detected|' || c"),
)]
T, D = "CAST(length(title) AS VARCHAR)", "CAST(length(descr) AS VARCHAR)"
PX = audit.WIDTH
ALIKE = "(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END)"
TITLES = f", y AS (SELECT *, {audit.SET.format('h1')} AS a, {audit.SET.format('title')} AS b, {PX} AS px, count(*) OVER (PARTITION BY project_id, lower(title)) AS n_title, count(*) OVER (PARTITION BY project_id, lower(descr)) AS n_descr FROM std)\n"
VERBS = "|".join(page_rules.ACTIONS)
titles = [rule(w, i, s, d, "y") for w, i, s, d in (
    ("title = ''", "'Missing Title'", 0, "'0'"), ("length(title) BETWEEN 1 AND 29", "'Title Too Short'", 1, T), ("length(title) > 70", "'Title Too Long (Will Truncate)'", 1, T), ("length(title) BETWEEN 61 AND 70", "'Title Long (May Truncate)'", 1, T), ("px > 600", "'Title Pixel Width Exceeded (~' || px || 'px)'", 2, T), ("px BETWEEN 581 AND 600", "'Title May Truncate on Mobile (~' || px || 'px)'", 2, T),
    ("title <> '' AND n_title > 1", "'Duplicate Title (' || n_title || ' pages)'", 0, T), ("descr = ''", "'Missing Meta Description'", 1, "'0'"), ("length(descr) BETWEEN 1 AND 49", "'Meta Description Too Short'", 1, D), ("length(descr) > 200", "'Meta Description Too Long (Will Truncate)'", 1, D), ("length(descr) BETWEEN 161 AND 200", "'Meta Description Long (May Truncate)'", 2, D),
    ("descr <> '' AND n_descr > 1", "'Duplicate Meta Description (' || n_descr || ' pages)'", 1, D), (f"descr <> '' AND NOT regexp_matches(lower(descr), '\\b({VERBS})\\b')", "'Description Lacks Action Words'", 2, D), ("title <> '' AND NOT regexp_matches(title, '[|\\-•→–—\\[\\]():]')", "'Title Lacks Visual Separators'", 2, T),
    ("viewports > 1", "'Multiple Viewport Declarations (' || viewports || ')'", 1, "'0'"), ("viewports = 0", "'Missing Viewport Meta Tag'", 1, "'0'"), ("charset = ''", "'Missing Charset Declaration'", 1, "'0'"), ("charset = 'iso-8859-1'", "'Non-UTF8 Charset (iso-8859-1)'", 2, "'0'"), ("n_charset > 1", "'Multiple Charset Declarations (' || n_charset || ')'", 1, "'0'"), ("lang = ''", "'Missing Lang Attribute'", 1, "'0'"),
    ("n_og = 0", "'Missing Open Graph Tags'", 1, "'0'"), ("n_og BETWEEN 1 AND 3", "'Incomplete Open Graph (' || n_og || '/4)'", 2, "'0'"), ("NOT twitter", "'Missing Twitter Card Tags'", 2, "'0'"), ("n_h1 = 0", "'Missing H1 Tag'", 0, "'0'"), ("n_h1 > 1", "'Multiple H1 Tags (' || n_h1 || ')'", 1, "'0'"), ("n_h1 = 1 AND h1 = ''", "'Empty H1 Tag'", 1, "'0'"),
    ("n_h1 = 1 AND h1 <> '' AND lower(h1) = lower(title)", "'Identical H1 and Title'", 2, "'0'"), (f"n_h1 = 1 AND h1 <> '' AND title <> '' AND lower(h1) <> lower(title) AND {ALIKE} < 0.3", "'H1 and Title Unrelated'", 2, "'0'"), ("n_h2 = 0 AND n_h3 + n_h4 > 0", "'Heading Hierarchy Skips H2'", 2, "'0'"), ("n_h2 > 0 AND n_h3 = 0 AND n_h4 > 0", "'Heading Hierarchy Skips H3'", 2, "'0'"), ("keywords", "'Meta Keywords Tag Found (Outdated)'", 2, "'0'"),
)]
CODES = "CASE WHEN bad_tag THEN 'en' || CASE WHEN x_default THEN ', x-default' ELSE '' END || ', xx-zz' ELSE 'de-de, en' || CASE WHEN k % 6 = 4 THEN ', fr' ELSE '' END || CASE WHEN x_default THEN ', x-default' ELSE '' END END"
HREFLANG = ", y AS (SELECT * FROM std WHERE lang_tags)\n"
hreflang = [rule(w, i, s, d, "y") for w, i, s, d in (
    ("bad_tag", "'Invalid Hreflang Syntax (1 tags)'", 0, "'xx-zz'"), ("k % 6 = 4 AND NOT x_default", "'Missing x-default Hreflang'", 1, CODES), ("c <> address", "'Hreflang/Canonical Conflict'", 1, CODES), ("k + 12 IN (SELECT k FROM y)", "'Missing Bidirectional Links (1 targets)'", 0, "''"),
)]
LINKS = ", e AS (SELECT k AS a, k + 4 AS b, anchor AS t FROM std WHERE outs > 0 UNION ALL SELECT k, k + 8, 'Page about ships' FROM std WHERE outs > 1), near AS (SELECT * FROM e WHERE b % 37 <> 11), inward AS (SELECT b AS k, count(*) AS n_in, count(*) FILTER (WHERE t = 'Click here') AS n_generic FROM near GROUP BY b), y AS (SELECT std.*, COALESCE(n_in, 0) AS n_in, COALESCE(n_generic, 0) AS n_generic, (SELECT count(*) FROM near WHERE a = std.k) AS n_out FROM std LEFT JOIN inward USING (k))\n"
COUNTS = "'|' || n_in || '|' || n_out"
linking = [
    rule("n_out = 0", "'No Outlinks'", 2, COUNTS, "y"), rule("n_out BETWEEN 1 AND 2 AND depth <= 2", "'Few Outlinks'", 2, COUNTS, "y"), rule("n_in = 0 AND depth > 1", "'Orphan Page'", 1, COUNTS, "y"), rule("2 * n_generic > n_in", "'Generic Anchor'", 2, f"'Click here' || {COUNTS}", "y JOIN near ON near.b = y.k AND near.t = 'Click here'"),
]
SITEMAP = """, m AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY k) AS nth FROM x WHERE k % 3 <> 1 AND project_id < 4), h AS (SELECT * FROM m WHERE nth <= 100),
maps AS (SELECT p.project_id, (SELECT count(*) FROM m WHERE m.project_id = p.project_id) AS n, (SELECT count(*) FROM h WHERE h.project_id = p.project_id AND k % 50 = 6) AS n_future, (SELECT count(*) FROM h WHERE h.project_id = p.project_id AND k % 50 <> 6 AND k % 2 = 0) AS n_old, (SELECT count(*) FROM h WHERE h.project_id = p.project_id AND k % 70 = 8) AS n_off, (SELECT count(*) FROM h WHERE h.project_id = p.project_id) AS n_rated,
(SELECT count(*) FROM m WHERE m.project_id = p.project_id AND nth <= 1000 AND status = 404) AS n404, (SELECT count(*) FROM m WHERE m.project_id = p.project_id AND nth <= 1000 AND status = 500) AS n500, (SELECT count(*) FROM m WHERE m.project_id = p.project_id AND nth <= 1000 AND status BETWEEN 300 AND 399) AS n300,
(SELECT count(*) FROM std WHERE std.project_id = p.project_id AND k % 3 <> 1 AND depth > 0 AND NOT EXISTS (SELECT 1 FROM std l WHERE l.k = std.k - 4 AND l.outs > 0) AND NOT EXISTS (SELECT 1 FROM std l WHERE l.k = std.k - 8 AND l.outs > 1)) AS n_lonely, (SELECT count(*) FROM std WHERE std.project_id = p.project_id AND k % 3 = 1) AS n_unlisted FROM (SELECT DISTINCT project_id FROM x) p)
"""
MAP = "CAST(1000000000 + project_id - 1 AS BIGINT)"
sitemap = [rule(w, i, s, "'Yes'", "maps", u) for w, i, s, u in (
    ("project_id = 4", "'Sitemap Not Found'", 1, MAP), ("n BETWEEN 1 AND 45000", "'Sitemap Parsed (' || format('{:,}', n) || ' URLs)'", 2, MAP), ("n_rated >= 10", "'All Priority 1.0 (Defeats Purpose)'", 1, MAP), ("n_future > 0", "'Future Lastmod Dates (' || n_future || ')'", 1, MAP), ("n_old > 10", "'Outdated URLs (' || n_old || ' > 2 years old)'", 2, MAP),
    ("n_off > 0", "'Invalid Priority Values (' || n_off || ')'", 0, MAP), ("n404 > 0", "'Sitemap Contains 404s (' || n404 || ' URLs)'", 0, MAP), ("n500 > 0", "'Sitemap Contains 5xx Errors (' || n500 || ' URLs)'", 0, MAP), ("n300 > 0", "'Sitemap Contains Redirects (' || n300 || ' URLs)'", 1, MAP),
    ("project_id < 4 AND n_lonely > 0", "'Orphan URLs in Sitemap (' || n_lonely || ')'", 1, "CAST(-1 AS BIGINT)"), ("n > 0 AND n_unlisted > 0", "'URLs Missing from Sitemap (' || n_unlisted || ')'", 2, "CAST(-1 AS BIGINT)"),
)]
COPIES = f", y AS (SELECT k, count(*) OVER (PARTITION BY project_id) AS n FROM std WHERE {planted.COPY})\n"
PROBED = [("Correct (301)", 2), ("Temporary Redirect (302)", 0), ("Wrong Target", 1), ("Duplicate Content", 0), ("Timeout", 1), ("Error (HTTP 503)", 1), ("Unreachable", 1)]
copies = [rule("n > 1", "'Exact Duplicate (' || n || ' pages)'", 0, "'100'", "y"), *(f"SELECT CAST(-1 AS BIGINT), 'Domain Variant {i}', CAST({s} AS INTEGER), '0'" for i, s in PROBED)]
ORIGIN = audit.origin("address")
BROKEN = f""", page AS (SELECT * FROM x WHERE html AND ok), hyper AS (SELECT k, project_id, address, 'Hyperlink' AS type, k + 4 AS b, nofollow FROM page WHERE outs > 0 UNION ALL SELECT k, project_id, address, 'Hyperlink', k + 8, false FROM page WHERE outs > 1),
inner_links AS (SELECT h.k, h.nofollow, {planted.address('b')} AS url, t.status AS code FROM hyper h LEFT JOIN x t ON t.k = h.b WHERE (h.k % 37 = 11) = (h.b % 37 = 11)),
img AS (SELECT k, {ORIGIN} || '/a' || k || '.png' AS url, 2 AS n FROM page WHERE n_images > 0 UNION ALL SELECT k, {ORIGIN} || '/icon.svg', 1 FROM page WHERE n_images > 3 UNION ALL SELECT k, {ORIGIN} || '/c.webp', 1 FROM page WHERE n_images > 4)
"""
ONE = "url || '|Hyperlink|1'"
broken = [rule(w, i, s, d, f) for w, i, s, d, f in (
    ("code IS NULL", "'Link Not Crawled'", 1, ONE, "inner_links"), ("code >= 400", "'Broken Hyperlink'", 0, ONE, "inner_links"), ("code BETWEEN 300 AND 399", "'Link Points to Redirect'", 2, ONE, "inner_links"), ("nofollow", "'Nofollow on Internal Link'", 1, ONE, "inner_links"),
    *((f"outs > 1 AND k % 5 = {m}", f"'{i}'", s, f"'https://ext.example.com/x{m}|Hyperlink|1'", "page") for m, i, s in ((1, "Broken Hyperlink", 0), (2, "Forbidden Link", 2), (3, "Connection Failed (Hyperlink)", 1))),
    ("outs > 1 AND fragment = 'nowhere'", "'Broken Anchor Link'", 1, "address || '#nowhere|Anchor|1'", "page"), ("true", "'Link Not Crawled'", 1, "url || '|Image|' || n", "img"),
)]
WORDS = [w.replace("'", "''") for w in page_rules.MISSING_PAGE]
MATCHES = " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in WORDS for c in ("lower(title)", f"lower({FIRST_H1})", "substring(lower(body), 1, 500)"))
BUDGET = f", y AS (SELECT *, {MATCHES} AS matches FROM x WHERE internal AND html AND ok), rates AS (SELECT project_id, count(*) + 1 AS n, count(*) FILTER (WHERE status >= 500) AS bad FROM x WHERE internal GROUP BY project_id)\n"
budget = [
    rule("internal AND status = 500", "'Server Error (HTTP 500)'", 1, "''", "x"), rule("matches > 0 OR length(body) < 200 AND regexp_matches(lower(title), 'error|not found')", "'Soft 404 (' || CASE WHEN matches = 1 AND length(body) > 500 THEN 'medium' ELSE 'high' END || ' confidence)'", 1, "''", "y"),
    rule("n >= 50 AND bad > 0.05 * n", "'High Server Error Rate (' || CAST(floor(100.0 * bad / n) AS INTEGER) || '%)'", 0, "bad || ' of ' || n || ' pages'", "rates", "CAST(-1 AS BIGINT)"),
]
BOAT, CDN, ICON, ROW, DATA, PLAIN = f"{ORIGIN} || '/a' || k || '.png|A boat in the harbour'", "'https://cdn.example.com/b' || k || '.webp|'", f"{ORIGIN} || '/icon.svg|icon'", f"{ORIGIN} || '/c.webp|image of ' || repeat('a long row ', 12)", "substring('data:image/png;base64,' || repeat('QUJD', 4000), 1, 100) || '...|'", "'http://plain.example.com/i.webp|plain picture of boats'"
images = [rule(w, f"'{i}'", s, d) for w, i, s, d in (
    ("n_images > 0", "Missing Lazy Loading", 2, BOAT), ("n_images > 0", "Missing Responsive Images", 2, BOAT), ("n_images > 0", "Legacy Image Format", 2, BOAT), ("n_images > 1", "Missing Image Source", 0, "'|nothing'"), ("n_images > 2", "Missing Image Dimensions", 1, CDN), ("n_images > 2", "External Image Hotlink", 2, CDN), ("n_images > 2", "Missing Alt Text", 1, CDN),
    ("n_images > 3", "SVG with Pixel Dimensions", 2, ICON), ("n_images > 3", "Alt Text Too Short", 2, ICON), ("n_images > 3", "Potentially Decorative Image", 2, ICON), ("n_images > 3", "Redundant Title Attribute", 2, ICON), ("n_images > 4", "Alt Text Too Long", 1, ROW), ("n_images > 4", "Alt Text Bad Pattern", 2, ROW), ("n_images > 5", "Large Data URI (11KB)", 1, DATA), ("insecure > 0", "External Image Hotlink", 2, PLAIN),
)]
PLACE = r"\d+\s+[A-Z][a-z]+\s+(Ave|Avenue|Blvd|Boulevard|Court|Ct|Dr|Drive|Lane|Ln|Rd|Road|St|Street|Way)|[A-Z][a-z]+,\s*[A-Z]{2}\s+\d{5}|\d{5}(-\d{4})?"
structured = [rule(w, f"'{i}'", s, f"'{d}'") for w, i, s, d in (
    ("json = 0", "Incomplete Article Schema", 1, "datePublished, image"), ("json = 1", "Complete with Star Ratings", 2, "aggregateRating"), ("json = 2", "Incomplete Product Schema", 0, "image, offers or price"), ("json = 2", "Product Recommendations (3)", 1, "aggregateRating is recommended, brand is recommended"),
    ("json = 3", "FAQ Missing Answers (1)", 1, "acceptedAnswer"), ("json = 3", "FAQ Short Answers (1)", 2, "acceptedAnswer"), ("json = 4", "Breadcrumb Found (2 levels)", 2, "itemListElement"), ("json = 5", "Empty BreadcrumbList", 1, "itemListElement"), ("json = 6", "Missing step", 1, "step"), ("json = 7", "Review Recommendations (3)", 1, "ratingValue should be 1 to 5, reviewBody is recommended"),
    ("json <= 6", "JSON-LD Found (1 schemas)", 2, "@type"), ("json = 7", "JSON-LD Found (2 schemas)", 2, "@type"), ("micro", "Microdata Found (1 items)", 2, "itemtype"), ("k % 11 IN (0, 4)", "Missing Author Markup", 2, "author"), (f"k % 11 IN (2, 5) AND regexp_matches(body, '{PLACE}')", "Missing Phone Number", 2, "telephone"), (f"k % 11 IN (2, 5) AND NOT regexp_matches(body, '{PLACE}')", "Missing Contact Info", 2, "telephone, address"),
    *((f"json = 9 AND NOT micro AND depth <= 2 AND k % 11 IN ({m})", "Missing Structured Data", 2, i) for m, i in (("0, 4", "Article or BlogPosting"), ("1", "Product"), ("2, 5", "Organization"))),
)]
structured.append(rule("json = 8", "'JSON Syntax Error'", 0))
extraction = [
    rule("project_id = 1 AND (n_h1 = 2 OR n_h1 = 1 AND h1 <> '')", "'Heading'", 2, "CASE n_h1 WHEN 2 THEN 'One heading' || chr(10) || 'Two heading' ELSE h1 END"), rule("project_id = 2", "'Extraction failed: Links'", 1, "'ERROR'"), rule("project_id = 2 AND n_h1 = 1 AND starts_with(h1, 'Heading on')", "'Number'", 2, "k"),
]
GRAPH = ", y AS (SELECT x.k, x.outs, CASE x.k % 5 WHEN 0 THEN 'hyperlink' WHEN 1 THEN 'image link' WHEN 2 THEN 'script' WHEN 3 THEN 'stylesheet' ELSE 'resource' END AS kind_of, CASE WHEN x.k % 3 = 0 THEN '' ELSE x.anchor END AS said, t.address AS to_address FROM x LEFT JOIN x t ON t.k = x.k + 4 WHERE NOT x.ext AND x.outs > 0)\n"
graph = [rule("true", "'Internal ' || kind_of || CASE WHEN said = '' THEN ' without anchor text' ELSE ' with anchor text' END", 2, "COALESCE(to_address, 'Unknown') || '|' || CASE WHEN said = '' THEN '(no text)' ELSE said END", "y")]
RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES = {f"task_{name}": " ".join((head + union(rules)).split("\n")) for name, head, rules in (
    ("inventory", WITH, inventory), ("security", WITH, security), ("robots", WITH, robots), ("redirects", RECURSIVE + REDIRECTS, redirects), ("canonical", WITH + CANONICAL, canonical), ("titlesmeta", WITH + TITLES, titles), ("hreflang", WITH + HREFLANG, hreflang), ("internallinking", WITH + LINKS, linking), ("sitemap", WITH + SITEMAP, sitemap),
    ("duplicatecontent", WITH + COPIES, copies), ("brokenlinks", WITH + BROKEN, broken), ("crawlbudget", WITH + BUDGET, budget), ("imageaudit", WITH, images), ("structureddata", WITH, structured), ("customextraction", WITH, extraction), ("linkgraph", WITH + GRAPH, graph),
)}
IMAGES = " UNION ALL ".join(f"SELECT project_id, 1, false, {u} FROM x WHERE html AND {w}" for w, u in (("n_images > 0", f"{ORIGIN} || '/a' || k || '.png'"), ("n_images > 0", f"{ORIGIN} || '/a' || k || '.png'"), ("n_images > 2", "'https://cdn.example.com/b' || k || '.webp'"), ("n_images > 3", f"{ORIGIN} || '/icon.svg'"), ("n_images > 4", f"{ORIGIN} || '/c.webp'"), ("insecure > 0", "'http://plain.example.com/i.webp'")))
ORACLES |= {name: " ".join((head + sql).split("\n")) for name, head, sql in (
    ("extraction_pivot", WITH, "SELECT address AS \"Page\", CAST(CASE WHEN project_id = 2 THEN 1 ELSE 2 END AS INTEGER) AS \"Severity\", '' AS \"Bold\", CASE WHEN project_id = 1 THEN CASE n_h1 WHEN 2 THEN 'One heading' || chr(10) || 'Two heading' ELSE h1 END ELSE '' END AS \"Heading\", CASE WHEN project_id = 2 THEN 'ERROR' ELSE '' END AS \"Links\", CASE WHEN project_id = 2 AND n_h1 = 1 AND starts_with(h1, 'Heading on') THEN CAST(k AS VARCHAR) ELSE '' END AS \"Number\" FROM std WHERE project_id = 2 OR project_id = 1 AND (n_h1 = 2 OR n_h1 = 1 AND h1 <> '')"),
    ("orphan_pages", WITH + LINKS, "SELECT k AS url_id, address AS page, depth FROM y WHERE n_in = 0 AND depth > 1"),
    ("link_table", WITH, f"SELECT project_id, CAST(kind_of AS TINYINT) AS link_type, is_nofollow, count(*) AS links, count(DISTINCT target_norm) AS targets FROM (SELECT project_id, kind_of, is_nofollow, {audit.norm('to_url')} AS target_norm FROM (SELECT project_id, 0 AS kind_of, nofollow AS is_nofollow, {planted.address('(k + 4)')} AS to_url FROM x WHERE html AND outs > 0 UNION ALL SELECT project_id, 0, false, {planted.address('(k + 8)')} FROM x WHERE html AND outs > 1 UNION ALL SELECT project_id, 0, false, 'https://ext.example.com/x' || (k % 5) FROM x WHERE html AND outs > 1 UNION ALL {IMAGES})) GROUP BY ALL"),
    ("copies_on_arrival", WITH, f"SELECT k AS url_id, 'Exact Duplicate (' || n || ' pages)' AS issue, CAST(0 AS INTEGER) AS severity FROM (SELECT k, count(*) OVER (PARTITION BY project_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM std WHERE {planted.COPY}) WHERE n > 1"),
)}

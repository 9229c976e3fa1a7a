"""A crawl planted over the raw pages' numbers: every column follows from ``page_id`` by expressions that Spark and other SQL engines read alike, so that each task has cases of each of its rules.

Four sites share the pages (by page_id modulo 4). The markup is written from the columns and parsed as any page is; the expected findings can be told from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import model
from siteloom.plans.lineage import checkpoint

SITES = 4


def site(k: str) -> str:
    return f"('https://www.s' || ({k} % {SITES}) || '.example.org')"


def path(k: str) -> str:
    section = f"(CASE {k} % 11 WHEN 0 THEN '/blog' WHEN 1 THEN '/Product' WHEN 2 THEN '/about' WHEN 3 THEN '/under_score' WHEN 4 THEN '/news' WHEN 5 THEN '/contact' ELSE '/docs' END)"
    tail = f"(CASE WHEN {k} % 29 = 7 THEN repeat('x', 80) WHEN {k} % 29 = 8 THEN repeat('y', 45) WHEN {k} % 17 = 4 THEN '|x' ELSE '' END)"
    return f"({section} || '/p' || {k} || {tail})"


def query(k: str) -> str:
    return f"(CASE {k} % 13 WHEN 1 THEN '?page=2&a=1&b=2&c=3' WHEN 2 THEN '?sid=ABC' WHEN 3 THEN '?q=1' ELSE '' END)"


def address(k: str) -> str:
    return f"((CASE WHEN {k} % 23 = 5 THEN 'http' ELSE 'https' END) || '://' || (CASE WHEN {k} % 37 = 11 THEN 'other.example.net' ELSE 'www.s' || ({k} % {SITES}) || '.example.org' END) || {path(k)} || {query(k)})"


def norm(k: str) -> str:
    """The normal form of a page's address."""
    return f"lower((CASE WHEN {k} % 23 = 5 THEN 'http' ELSE 'https' END) || '://' || (CASE WHEN {k} % 37 = 11 THEN 'other.example.net' ELSE 'www.s' || ({k} % {SITES}) || '.example.org' END) || {path(k)})"


def external(k: str) -> str:
    return f"({k} % 37 = 11)"


def status(k: str) -> str:
    return f"(CASE {k} % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 301 WHEN 3 THEN 302 ELSE 200 END)"


def depth(k: str) -> str:
    return f"CAST({k} % 5 AS INT)"


#: Pages whose texts are equal.
COPY = "k % 24 = 10"
WORDS = " || ' ' || ".join(f"'w' || ((k * 7919 + {i} * 104729) % 1000003)" for i in range(40))
#: Name -> expression over k; a later one may not use an earlier one.
COLUMNS = {
    "k": "k", "project_id": f"CAST(k % {SITES} AS INT) + 1", "address": address("k"), "norm": norm("k"), "ext": external("k"), "depth": depth("k"), "status": status("k"),
    "kind": "CASE WHEN k % 31 = 9 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END",
    "title": "CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'Short ' || (k % 3) WHEN 2 THEN 'Title of page ' || k || repeat(' word', 13) WHEN 3 THEN 'Shared title of several pages | site' WHEN 4 THEN 'Title - ' || repeat('m', 54) || (k % 10) ELSE 'A good title of the page number ' || k || ' | Site' END",
    "descr": "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'Short one' WHEN 2 THEN 'Read ' || repeat('long text ', 21) || 'end' WHEN 3 THEN repeat('some words ', 15) || 'end' WHEN 4 THEN 'Shared description of several pages that tells how to find out more about it' ELSE 'Discover page ' || k || ' and all that it has to say about its subject today' END",
    "n_h1": f"CASE WHEN {COPY} THEN 1 WHEN k % 7 = 0 THEN 0 WHEN k % 7 = 1 THEN 2 ELSE 1 END",
    "h1": f"CASE WHEN {COPY} THEN 'Same heading' WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'One heading' WHEN k % 7 = 2 THEN '' WHEN k % 7 = 3 AND k % 9 > 4 THEN 'A good title of the page number ' || k || ' | Site' ELSE 'Heading on harbours ' || k END",
    "n_h2": f"CASE WHEN {COPY} THEN 1 WHEN k % 6 = 0 THEN 0 ELSE 1 END", "n_h3": f"CASE WHEN {COPY} THEN 1 WHEN k % 6 = 1 THEN 0 ELSE 1 END", "n_h4": f"CASE WHEN {COPY} THEN 0 WHEN k % 6 = 1 THEN 1 ELSE 0 END",
    "viewports": "CASE k % 10 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END", "charset": "CASE k % 14 WHEN 2 THEN '' WHEN 3 THEN 'iso-8859-1' ELSE 'utf-8' END", "n_charset": "CASE k % 14 WHEN 2 THEN 0 WHEN 5 THEN 2 ELSE 1 END",
    "lang": "CASE WHEN k % 15 = 1 THEN '' ELSE 'en' END", "n_og": "CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END", "twitter": "k % 3 <> 0", "keywords": "k % 19 = 8",
    "robots": "CASE k % 16 WHEN 1 THEN 'noindex' WHEN 2 THEN 'nofollow' WHEN 3 THEN 'none' ELSE '' END",
    "x_robots": "CASE k % 18 WHEN 1 THEN 'noindex' WHEN 2 THEN 'noarchive, nosnippet' WHEN 3 THEN 'max-snippet: 0' WHEN 4 THEN 'max-image-preview: large, max-video-preview: -1' WHEN 5 THEN 'unavailable_after: 2030, indexifembedded' WHEN 6 THEN 'noimageindex' WHEN 7 THEN 'googlebot-news: nosnippet' ELSE '' END",
    "canon": f"CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN {address('(k + 4)')} WHEN k % 10 = 2 THEN 'https://copy.example.com/p' || k WHEN k % 40 = 13 THEN {address('(k + 20)')} WHEN k % 40 = 33 THEN {address('(k - 20)')} ELSE {address('k')} END",
    "n_canon": "CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 3 AND k % 40 NOT IN (13, 33) THEN 2 ELSE 1 END",
    "words": WORDS,
    "outs": f"CASE WHEN {COPY} THEN 2 WHEN k % 10 = 9 THEN 0 WHEN k % 10 = 8 THEN 1 ELSE 2 END", "anchor": f"CASE WHEN {COPY} THEN 'Page about boats' WHEN k % 6 = 0 THEN 'Click here' ELSE 'Page about boats' END", "nofollow": "k % 12 = 5", "fragment": "CASE WHEN k % 9 = 4 THEN 'nowhere' ELSE 'top' END",
    "hsts": "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'max-age=100' ELSE 'max-age=31536000' END", "nosniff": "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'nosniff' END", "cookie": "CASE k % 6 WHEN 0 THEN 'a=1; Secure; HttpOnly' WHEN 1 THEN 'a=1; Path=/' WHEN 2 THEN 'a=1,b=2' ELSE '' END",
    "insecure": "CASE k % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "refresh": "k % 26 = 6", "script_to": "k % 26 = 8", "max_age": "CASE WHEN k % 40 = 3 THEN 172800 ELSE 0 END",
    "lang_tags": "k % 6 IN (2, 3, 4)", "bad_tag": "k % 18 = 2", "x_default": "k % 12 IN (2, 3, 4)", "n_images": "k % 7",
    "json": "CAST((k % 70 - k % 7) / 7 AS INT)", "micro": "k % 22 = 4",
}
#: Name -> expression over the columns above.
DERIVED = {"para": f"CASE WHEN {COPY} THEN 'The same paragraph on every copy ' || repeat('with words ', 200) WHEN k % 7 = 4 THEN 'page not found, sorry ' || words WHEN k % 7 = 5 THEN repeat(words || ' ', 3) || 'end' ELSE repeat(words || ' ', 7) || 'end' END"}
#: Where a redirecting page leads: to the next of its site, back again for some, to plain HTTP or nowhere for others.
TARGET = f"CASE WHEN k % 80 = 2 THEN {address('(k + 20)')} WHEN k % 80 = 22 THEN {address('(k - 20)')} WHEN k % 80 = 42 THEN {address('(k + 20)')} WHEN k % 80 = 62 THEN {address('(k + 38)')} WHEN k % 80 = 3 THEN replace({address('(k + 4)')}, 'https://', 'http://') WHEN k % 80 = 23 THEN NULL WHEN k % 80 = 43 THEN {address('k')} || '/' WHEN k % 80 = 63 THEN replace({address('(k + 8)')}, '://www.', '://') END"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COLUMNS, DERIVED and target of each page, written once: what reads them would else repeat their expressions."""
    base = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("k")).repartition(spark.sparkContext.defaultParallelism)  # numbers alone move
    first = checkpoint(base.selectExpr(*(f"{sql} AS {name}" for name, sql in COLUMNS.items()), f"CASE WHEN {status('k')} IN (301, 302) THEN {TARGET} END AS target"))
    return first.selectExpr("*", *(f"{sql} AS {name}" for name, sql in DERIVED.items()))


def images(k: str) -> list[str]:
    """Markup of up to six images; the i-th is there where page_id modulo 7 is above i."""
    return [
        f"'<img src=\"/a' || {k} || '.png\" alt=\"A boat in the harbour\" width=\"500\" height=\"300\"><img src=\"/a' || {k} || '.png\" alt=\"Another text\" width=\"500\" height=\"300\">'",
        "'<img src=\"\" alt=\"nothing\">'",
        f"'<img src=\"https://cdn.example.com/b' || {k} || '.webp\" alt=\"\" loading=\"lazy\">'",
        "'<img src=\"/icon.svg\" alt=\"icon\" title=\"Icon\" width=\"16\" height=\"16\">'",
        f"'<img src=\"/c.webp\" alt=\"image of ' || repeat('a long row ', 12) || '\" width=\"10\" height=\"10\" loading=\"lazy\">'",
        "'<img src=\"data:image/png;base64,' || repeat('QUJD', 4000) || '\" alt=\"\">'",
    ]


#: JSON-LD blocks by the column json.
BLOCKS = {
    0: '{"@type":"Article","headline":"h","author":"a"}', 1: '{"@type":"Product","name":"n","image":"i","price":1,"brand":"b","description":"d","aggregateRating":{"ratingValue":4,"reviewCount":2}}', 2: '{"@type":"Product","name":"n"}',
    3: '{"@type":"FAQPage","mainEntity":[{"acceptedAnswer":{"text":"short"}},{}]}', 4: '{"@type":"BreadcrumbList","itemListElement":[1,2]}', 5: '{"@type":"BreadcrumbList","itemListElement":[]}', 6: '{"@type":"HowTo"}', 7: '[{"@type":"Review","itemReviewed":1,"reviewRating":{"ratingValue":9},"author":"a"},{"@type":"Other"}]',
}
HEAD = r"""concat('<!DOCTYPE html><html', CASE WHEN lang = '' THEN '' ELSE ' lang="en"' END, '><head><title>', title, '</title>', CASE WHEN descr = '' THEN '' ELSE '<meta name="description" content="' || descr || '">' END,
repeat('<meta name="viewport" content="w">', viewports), repeat('<meta charset="' || charset || '">', n_charset), CASE WHEN n_og > 0 THEN '<meta property="og:title" content="t">' ELSE '' END, CASE WHEN n_og > 1 THEN '<meta property="og:type" content="t"><meta property="og:url" content="t"><meta property="og:image" content="t"><meta property="og:description" content="t">' ELSE '' END,
CASE WHEN twitter THEN '<meta name="twitter:card" content="c">' ELSE '' END, CASE WHEN keywords THEN '<meta name="keywords" content="a,b">' ELSE '' END, CASE WHEN robots = '' THEN '' ELSE '<meta name="robots" content="' || robots || '">' END, CASE WHEN refresh THEN '<meta http-equiv="refresh" content="3; url=/next">' ELSE '' END,
CASE WHEN n_canon > 0 THEN repeat('<link rel="canonical" href="' || canon || '">', n_canon) ELSE '' END, CASE WHEN script_to THEN '<script>window.location.href = "/moved";</script>' ELSE '' END, CASE WHEN micro THEN '<meta itemscope itemtype="https://schema.org/Thing">' ELSE '' END)"""


def crawl(spark: SparkSession, sf_dir: str) -> model.Crawl:
    x = rows(spark, sf_dir)
    own = site("k")
    tags = "CASE WHEN lang_tags THEN concat('<link rel=\"alternate\" hreflang=\"en\" href=\"', address, '\"><link rel=\"alternate\" hreflang=\"', CASE WHEN bad_tag THEN 'xx-zz' ELSE 'de-DE' END, '\" href=\"', " + address("(k + 12)") + ", '\">', CASE WHEN k % 6 = 4 THEN '<link rel=\"alternate\" hreflang=\"fr\" href=\"https://fr.example.com/\">' ELSE '' END, CASE WHEN x_default THEN concat('<link rel=\"alternate\" hreflang=\"x-default\" href=\"', address, '\">') ELSE '' END) ELSE '' END"
    blocks = "CASE json " + " ".join(f"WHEN {i} THEN '<script type=\"application/ld+json\">{b}</script>'" for i, b in BLOCKS.items()) + " WHEN 8 THEN '<script type=\"application/ld+json\">{broken</script>' ELSE '' END"
    body = f"""concat('<body id="top">', CASE WHEN n_h1 > 1 THEN '<h1>One heading</h1><h1>Two heading</h1>' WHEN n_h1 = 1 THEN '<h1>' || h1 || '</h1>' ELSE '' END, repeat('<h2>Part</h2>', n_h2), repeat('<h3>Section</h3>', n_h3), repeat('<h4>Item</h4>', n_h4), '<p>', para, '</p>',
CASE WHEN outs > 0 THEN concat('<a href="', {address('(k + 4)')}, '"', CASE WHEN nofollow THEN ' rel="nofollow"' ELSE '' END, '>', anchor, '</a>') ELSE '' END, CASE WHEN outs > 1 THEN concat('<a href="', {address('(k + 8)')}, '">Page about ships</a><a href="https://ext.example.com/x', k % 5, '">Elsewhere</a><a href="#', fragment, '">Up</a>') ELSE '' END,
{', '.join(f"CASE WHEN n_images > {i} THEN {m} ELSE '' END" for i, m in enumerate(images('k')))}, CASE WHEN insecure > 0 THEN '<img src="http://plain.example.com/i.webp" alt="plain picture of boats" loading="lazy" width="5" height="5">' ELSE '' END, CASE WHEN insecure > 1 THEN '<iframe src="http://plain.example.com/f"></iframe>' ELSE '' END, '</body></html>')"""
    html = x.select("k", "project_id", "address", "kind", "status", F.expr(f"concat({HEAD}, {tags}, {blocks}, '</head>', {body})").alias("html")).where("kind like 'text/html%'")
    projects = x.groupBy("project_id").agg(F.min(F.expr(f"{own} || '/'")).alias("base_url")).withColumns({"name": F.col("base_url"), "user_agent": F.lit("bot"), "max_depth": F.lit(5), "max_urls": F.lit(1000), "respect_robots": F.lit(True), "last_opened": F.lit(None).cast("timestamp")})
    none = lambda kind: F.lit(None).cast(kind)
    urls = x.select(F.col("k").alias("url_id"), "project_id", "address", "depth", F.lit(2).cast("tinyint").alias("status"), F.col("status").cast("int").alias("http_status"), F.col("kind").alias("content_type"), F.lit(10).cast("long").alias("content_length"), none("timestamp").alias("first_seen"), none("timestamp").alias("last_crawled"), F.lit(True).alias("robots_allowed"), F.col("target").alias("redirect_target"), (F.expr("k % 100 = 82")).alias("is_redirect_loop"))
    maps = projects.select((F.col("project_id") - 1 + 1_000_000_000).cast("long").alias("url_id"), "project_id", F.concat("base_url", F.lit("sitemap.xml")).alias("address"), F.lit(9).alias("depth"), F.lit(2).cast("tinyint").alias("status"), F.when(F.col("project_id") == 4, 404).otherwise(200).alias("http_status"), F.lit("application/xml").alias("content_type"), F.lit(10).cast("long").alias("content_length"), none("timestamp").alias("first_seen"), none("timestamp").alias("last_crawled"), F.lit(True).alias("robots_allowed"), none("string").alias("redirect_target"), F.lit(False).alias("is_redirect_loop"))
    entries = x.where("k % 3 <> 1 and project_id < 4").select("project_id", "k", F.expr(f"concat('<url><loc>', replace({norm('k')}, '&', '&amp;'), '</loc><lastmod>', CASE WHEN k % 50 = 6 THEN '2999-01-01' WHEN k % 2 = 0 THEN '2020-01-01' ELSE '' END, '</lastmod><priority>', CASE WHEN k % 70 = 8 THEN '7' ELSE '1.0' END, '</priority></url>')").alias("entry"))
    text = entries.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda e: e["entry"]), "").alias("body"))
    sitemaps = maps.join(text, "project_id").select(F.col("address").alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</urlset>")).alias("content"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = {"Strict-Transport-Security": "hsts", "Content-Security-Policy": "CASE WHEN k % 9 = 0 THEN '' ELSE 'default-src' END", "X-Content-Type-Options": "nosniff", "X-Frame-Options": "'DENY'", "Referrer-Policy": "'origin'", "Set-Cookie": "cookie", "X-Robots-Tag": "x_robots", "Cache-Control": "CASE WHEN max_age > 0 THEN 'max-age=' || max_age ELSE '' END", "Link": "CASE WHEN k % 21 = 6 THEN '<https://www.s0.example.org/canonical>; rel=\"canonical\"' ELSE '' END"}
    headers = x.select(F.col("k").alias("url_id"), F.explode(F.array(*(header(n, F.expr(v)) for n, v in pairs.items()))).alias("h")).select("url_id", "h.name", "h.value", F.lit(0).alias("seq")).where("value <> ''")
    links = x.where("outs > 0").select("project_id", F.col("k").alias("from_url_id"), (F.col("k") + 4).alias("to_url_id"), F.when(F.col("k") % 3 == 0, "").otherwise(F.col("anchor")).alias("anchor_text"), F.expr("cast(k % 5 as tinyint)").alias("link_type"), none("string").alias("rel"), "nofollow", F.lit(False).alias("is_ugc"), F.lit(False).alias("is_sponsored"), none("string").alias("dom_path")).withColumnRenamed("nofollow", "is_nofollow")
    local = lambda values, name: spark.createDataFrame(values, model.schema(name))
    outer = local([(f"https://ext.example.com/x{i}", "bot", s, 0.1, None) for i, s in enumerate((200, 404, 403, 0))], "external_status")
    probes = local([(1, "http://s0.example.org/", 301, "https://www.s0.example.org/", None), (1, "https://s0.example.org/", 302, "https://www.s0.example.org/", None), (2, "http://s1.example.org/", 301, "https://elsewhere.example.org/", None), (2, "https://s1.example.org/", 200, None, None), (3, "http://s2.example.org/", None, None, "timeout"), (3, "https://s2.example.org/", 503, None, None), (4, "http://s3.example.org/", None, None, "unreachable")], "variant_probe")
    rules = local([(1, 1, "Heading", "heading", 0, "h1", True), (2, 1, "Bold", "bold", 0, "b.none", True), (3, 2, "Links", "links", 1, "//a/@", True), (4, 2, "Number", "number", 2, r"harbours (\d+)", True), (5, 3, "Off", "off", 0, "h1", False)], "extraction_rules")
    robots = local([("www.s0.example.org", "User-agent: *\nDisallow: /x")], "robots_txt")
    return model.Crawl(spark, projects=projects.select(*(c.split()[0] for c in model.TABLES["projects"].split(", "))), urls=urls.unionByName(maps), page_html=html.select(F.col("k").alias("url_id"), "project_id", "address", "html"), headers=headers, links=links, sitemaps=sitemaps, robots_txt=robots, external_status=outer, variant_probe=probes, extraction_rules=rules)

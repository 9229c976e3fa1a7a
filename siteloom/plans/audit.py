"""The audit queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import base, dup_rules, graph_rules, page_rules, registry
from siteloom.plans import report
from siteloom.sources import overlay as O
from siteloom.sources import files, planted

#: Documents whose ids and hashes are broadcast at most, of 16 bytes each.
BROADCAST = 1_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = " ".join((WITH + sql).split("\n"))
        return f

    return add


URL = U.PATTERN.replace("'", "''")


def part(c: str, k: int) -> str:
    return f"regexp_extract({c}, '{URL}', {k})"


def authority(c: str) -> str:
    own = f"lower(regexp_replace({part(c, 2)}, '^[^@]*@', ''))"
    return f"(CASE lower({part(c, 1)}) WHEN 'http' THEN regexp_replace({own}, ':80$', '') WHEN 'https' THEN regexp_replace({own}, ':443$', '') ELSE {own} END)"


def host(c: str) -> str:
    return f"regexp_replace({authority(c)}, ':[0-9]+$', '')"


def path(c: str) -> str:
    return f"(CASE WHEN {part(c, 3)} = '' THEN '/' ELSE {part(c, 3)} END)"


def origin(c: str) -> str:
    return f"lower({part(c, 1)}) || '://' || {authority(c)}"


def norm(c: str) -> str:
    return f"(CASE WHEN {part(c, 2)} <> '' THEN {origin(c)} || lower({path(c)}) ELSE {c} END)"


def resolved(b: str, h: str) -> str:
    folder = f"regexp_replace({path(b)}, '[^/]*$', '')"
    return f"(CASE WHEN {part(h, 2)} <> '' THEN {h} WHEN starts_with({h}, '//') THEN 'https:' || {h} WHEN starts_with({h}, '/') THEN {origin(b)} || {h} WHEN starts_with({h}, '?') THEN {origin(b)} || {path(b)} || {h} WHEN starts_with({h}, '#') THEN {origin(b)} || {path(b)} || {part(b, 4)} || {h} ELSE {origin(b)} || {folder} || {h} END)"


def plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


WITH = f"""WITH p AS (SELECT page_id, url, html, CAST(page_id % 5 AS INTEGER) AS depth, CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 301 WHEN 3 THEN 302 ELSE 200 END AS status, {host('url')} AS site FROM pages),
f AS (SELECT *, {plain(f"regexp_extract(html, '{q(O.TITLE)}', 1)")} AS title, {plain(f"regexp_extract(html, '{q(O.H1)}', 1)")} AS h1, regexp_extract(html, '{q(O.LANG)}', 1) AS lang, lower(regexp_extract(html, '{q(O.CHARSET)}', 1)) AS charset, len(regexp_extract_all(html, '{q(O.H1)}')) AS n_h1 FROM p),
a0 AS (SELECT page_id, url, site, unnest(regexp_extract_all(html, '{q(O.ANCHOR)}')) AS a FROM p),
a1 AS (SELECT page_id, url, site, regexp_extract(a, '{q(O.ANCHOR)}', 1) AS href, {plain(f"regexp_extract(a, '{q(O.ANCHOR)}', 2)")} AS anchor FROM a0),
l AS (SELECT *, {resolved('url', 'href')} AS target FROM a1 WHERE NOT regexp_matches(lower(href), '^(javascript:|mailto:|tel:|#)')),
s AS (SELECT {norm('url')} AS norm, arg_max(status, {{'depth': depth, 'page_id': page_id}}) AS target_status FROM p GROUP BY 1),
r AS (SELECT x.page_id, {norm('x.url')} AS source, {norm('y.url')} AS target, x.status AS code FROM p x JOIN p y ON x.page_id = y.page_id - 5 * (y.page_id % 2) - 20 WHERE x.status BETWEEN 300 AND 399)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pages(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.features(O.pages(spark, sf_dir))


@query("SELECT page_id, url, title, n FROM (SELECT page_id, url, title, count(*) OVER (PARTITION BY lower(title)) AS n FROM f WHERE title <> '') WHERE n > 1 ORDER BY n DESC, title, page_id")
def dup_titles(spark, sf_dir):
    rows = features(spark, sf_dir).where("title != ''").select("page_id", "url", "title")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(F.lower("title")))).where("n > 1").orderBy(F.desc("n"), "title", "page_id")


WIDTH = "CAST(length(title) * 8 + (length(title) - length(regexp_replace(title, '[\\p{Lu}]', '', 'g'))) * 4 - (length(title) - length(regexp_replace(title, '[il!|., ]', '', 'g'))) * 4 AS INTEGER)"


@query(f"SELECT page_id, {WIDTH} AS px, CASE WHEN {WIDTH} > 600 THEN 'exceeded' WHEN {WIDTH} > 580 THEN 'mobile' ELSE 'fits' END AS verdict FROM f")
def title_pixel_width(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", X.pixel_width(F.col("title")).alias("px")).withColumn("verdict", F.when(F.col("px") > 600, "exceeded").when(F.col("px") > 580, "mobile").otherwise("fits"))


@query("SELECT page_id, title FROM f WHERE title <> '' AND NOT regexp_matches(title, '[|\\-•→–—\\[\\]():]')")
def title_separators(spark, sf_dir):
    return features(spark, sf_dir).where((F.col("title") != "") & ~F.col("title").rlike(r"[|\-•→–—\[\]():]")).select("page_id", "title")


@query("SELECT lang, charset, count(*) AS pages, CAST(sum(CASE WHEN lang = '' THEN 1 ELSE 0 END) AS BIGINT) AS without_lang, CAST(sum(CASE WHEN charset NOT IN ('utf-8', 'utf8') THEN 1 ELSE 0 END) AS BIGINT) AS other_charset FROM f GROUP BY lang, charset")
def lang_and_charset(spark, sf_dir):
    return features(spark, sf_dir).groupBy("lang", "charset").agg(F.count("*").alias("pages"), F.count_if(F.col("lang") == "").alias("without_lang"), F.count_if(~F.col("charset").isin("utf-8", "utf8")).alias("other_charset"))


SET = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2))"


@query(f"SELECT page_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 9) AS alike FROM (SELECT page_id, {SET.format('url')} AS x, {SET.format('title')} AS y FROM f)")
def title_url_jaccard(spark, sf_dir):
    return features(spark, sf_dir).select("page_id", F.round(X.jaccard(F.col("url"), F.col("title")), 9).alias("alike"))


BARE = "regexp_replace(url, '[?#].*$', '')"
QUERY = part("url", 4)
SESSION = "CASE " + " ".join(f"WHEN regexp_matches(url, '(?i){p}') THEN '{n} parameter detected ({e})'" for p, n, e in page_rules.SESSIONS) + " END"


@query(f"""SELECT page_id, issue FROM (
SELECT page_id, CASE WHEN length({BARE}) > 100 THEN 'URL length > 100 characters (excluding query)' WHEN length({BARE}) > 75 THEN 'URL length > 75 characters (excluding query)' END AS issue FROM p
UNION ALL SELECT page_id, CASE WHEN url <> lower(url) THEN 'Uppercase characters detected in URL' END FROM p
UNION ALL SELECT page_id, CASE WHEN {QUERY} <> '' AND len(string_split(substring({QUERY}, 2), '&')) > 3 THEN 'Too many query parameters (' || len(string_split(substring({QUERY}, 2), '&')) || ')' END FROM p
UNION ALL SELECT page_id, CASE WHEN {QUERY} <> '' AND regexp_matches(url, '(?i)[?&](page|p|pg|offset|start)=') THEN 'Pagination parameter detected in URL' END FROM p
UNION ALL SELECT page_id, CASE WHEN {QUERY} <> '' THEN {SESSION} END FROM p
UNION ALL SELECT page_id, CASE WHEN regexp_matches(url, '[^a-zA-Z0-9\\-_.~:/?#\\[\\]@!$&''()*+,;=%]') THEN 'Special characters found in URL' END FROM p
UNION ALL SELECT page_id, CASE WHEN contains({path('url')}, '_') THEN 'Underscore detected in path' END FROM p) WHERE issue IS NOT NULL""")
def url_rules(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url")
    return rows.select("page_id", F.explode(F.filter(F.array(*page_rules.url_rules(F.col("url"))), lambda x: x.isNotNull())).alias("f")).select("page_id", "f.issue")


@query(f"SELECT page_id, {norm('url')} AS norm, {host('url')} AS host, regexp_replace({host('url')}, '^www\\.', '') AS bare_host, {part('url', 4)} AS query_part FROM p")
def url_normalize(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.normalize(u).alias("norm"), U.host(u).alias("host"), U.bare_host(u).alias("bare_host"), U.query(u).alias("query_part"))


@query("SELECT site, count(*) AS pages, min(depth) AS least_depth, max(depth) AS most_depth, CAST(sum(CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM p GROUP BY site")
def host_inventory(spark, sf_dir):
    return pages(spark, sf_dir).groupBy("site").agg(F.count("*").alias("pages"), F.min("depth").alias("least_depth"), F.max("depth").alias("most_depth"), F.count_if(F.col("status").between(200, 299)).alias("good"))


EXT = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[^.]*)$', 1)"
LAST = f"regexp_extract(lower({path('url')}), '([^/]*)$', 1)"


@query(f"SELECT page_id, {EXT} AS extension, contains({LAST}, '.') AND NOT regexp_matches({LAST}, '\\.(html?|xhtml|php|aspx?|jspx?|cfm)$') AS static FROM p")
def url_extension(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.extension(F.col("url")).alias("extension"), U.is_static(F.col("url")).alias("static"))


SLASH = "regexp_replace(" + authority("base") + ", '^www\\.', '') || '/'"


@query(f"SELECT base, variant FROM (SELECT DISTINCT base, unnest(['http://' || {SLASH}, 'http://www.' || {SLASH}, 'https://' || {SLASH}, 'https://www.' || {SLASH}]) AS variant FROM (SELECT {origin('url')} || '/' AS base FROM p)) WHERE variant <> base")
def domain_variants(spark, sf_dir):
    bases = pages(spark, sf_dir).select(F.concat(U.origin(F.col("url")), F.lit("/")).alias("base")).distinct()
    return bases.select("base", F.explode(U.variants(F.col("base"))).alias("variant"))


@query("SELECT page_id, href, anchor, target FROM l")
def link_graph(spark, sf_dir):
    return O.links(pages(spark, sf_dir)).select("page_id", "href", "anchor", "target")


@query(f"SELECT {norm('target')} AS norm, count(*) AS inlinks, count(DISTINCT page_id) AS pages FROM l GROUP BY 1")
def inlinks(spark, sf_dir):
    return O.links(pages(spark, sf_dir)).groupBy(U.normalize(F.col("target")).alias("norm")).agg(F.count("*").alias("inlinks"), F.count_distinct("page_id").alias("pages"))


@query("SELECT upper(sha256(text)) AS content_hash, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.groupBy(X.sha256(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n > 1")


@query("SELECT doc_id, source, seen FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY sha256(text) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM documents WHERE text IS NOT NULL) WHERE seen > 1")
def dup_docs_on_arrival(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return docs.withColumn("seen", F.count("*").over(Window.partitionBy("hash").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))).where("seen > 1").drop("hash")


FOUND = "(SELECT page_id AS url_id, 'TitlesMeta' AS task_key, 'Title Too Short' AS issue_text, 1 AS severity FROM f WHERE length(title) < 30 UNION ALL SELECT page_id, 'Inventory', 'Uppercase characters detected in URL', 1 FROM p WHERE url <> lower(url) UNION ALL SELECT page_id, 'CrawlBudget', 'Server Error (HTTP ' || status || ')', CASE WHEN status = 500 THEN 0 ELSE 1 END FROM p WHERE status >= 400 UNION ALL SELECT page_id, 'Robots', 'Deep page', NULL FROM p WHERE depth = 4)"


def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rules' rows as the report layer holds them."""
    f = features(spark, sf_dir)
    rows = lambda when, task, issue, severity: f.where(when).select(F.col("page_id").alias("url_id"), F.lit(task).alias("task_key"), base.text(issue).alias("issue_text"), severity.cast("int").alias("severity"))
    parts = [rows("length(title) < 30", "TitlesMeta", "Title Too Short", F.lit(1)), rows("url != lower(url)", "Inventory", "Uppercase characters detected in URL", F.lit(1)), rows("status >= 400", "CrawlBudget", F.format_string("Server Error (HTTP %d)", "status"), F.when(F.col("status") == 500, 0).otherwise(1)), rows("depth = 4", "Robots", "Deep page", F.lit(None))]
    return graph_rules.union_all(parts).withColumns({"row_id": F.col("url_id"), "row_json": F.to_json(F.struct(F.col("issue_text").alias("Issue"))), "created": F.lit(None).cast("timestamp")})


@query(f"SELECT url_id, task_key, issue_text, severity FROM {FOUND} ORDER BY COALESCE(severity, 2147483647), COALESCE(issue_text, ''), url_id LIMIT 100 OFFSET 100")
def report_page(spark, sf_dir):
    return report.ReportQuery(found_rows(spark, sf_dir)).page(1, 100).select("url_id", "task_key", "issue_text", "severity")


@query(f"SELECT url_id, task_key, issue_text, severity FROM {FOUND} x JOIN pages ON page_id = url_id WHERE severity = 1 AND (contains(issue_text, 'HTTP 4') OR contains(url, 'www.'))")
def report_search(spark, sf_dir):
    addresses = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("url_id"), F.col("url").alias("address"))
    rows = found_rows(spark, sf_dir).select("url_id", "task_key", "issue_text", "severity", "row_json", "row_id", "created")
    one, two = (report.ReportQuery(rows, addresses).severity(1).search(t).filtered().select("url_id", "task_key", "issue_text", "severity") for t in ("HTTP 4", "www."))
    return one.unionByName(two).distinct()


@query(f"SELECT COALESCE(task_key, 'Total') AS task, count(*) AS rows, CAST(sum(CASE WHEN severity = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN severity = 1 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, CAST(sum(CASE WHEN severity = 2 THEN 1 ELSE 0 END) AS BIGINT) AS infos FROM {FOUND} GROUP BY ROLLUP (task_key)")
def report_summary(spark, sf_dir):
    return report.summary(found_rows(spark, sf_dir))


@query("SELECT event_type, count(*) AS events, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type")
def json_values(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", report.get("props", "k", "long"))
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("SELECT user_id, count(*) AS n, round(max(gap), 3) AS most, round(min(gap), 3) AS least FROM (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id")
def politeness_gaps(spark, sf_dir):
    from siteloom.streaming import frontier

    fetches = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"))
    gaps = frontier.politeness(fetches).where("gap is not null").withColumnRenamed("host", "user_id")
    return gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("gap"), 3).alias("most"), F.round(F.min("gap"), 3).alias("least"))


RULES = [("*", "/", True), ("*", "/en/", False), ("bot", "/en/7", True), ("other", "/", False), ("*", "/de", False)]


@query("SELECT page_id, COALESCE((SELECT arg_max(allow, length(prefix)) FROM (VALUES " + ", ".join(f"('{a}', '{p}', {str(x).lower()})" for a, p, x in RULES) + f") AS v(agent, prefix, allow) WHERE (agent = '*' OR contains('mybot', agent)) AND starts_with({path('p.url')} || {part('p.url', 4)}, prefix)), true) AS allowed FROM p")
def robots_allowed(spark, sf_dir):
    rows = pages(spark, sf_dir)
    rules = spark.createDataFrame([(a, p, x, i) for i, (a, p, x) in enumerate(RULES)], "agent string, prefix string, allow boolean, at int").crossJoin(rows.select(F.col("site").alias("host")).distinct())
    return files.allowed(rows.select("page_id", F.col("url").alias("address")), rules, "mybot").select("page_id", "allowed")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg|iframe)\\b[^>]*>.*?</(script|style|noscript|svg|iframe)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, CAST(length({CLEAN}) AS INTEGER) AS size, CASE WHEN length({CLEAN}) < 900 THEN 'Very short content' WHEN length({CLEAN}) < 1800 THEN 'Limited content length' ELSE 'ok' END AS issue, upper(sha256({CLEAN})) AS content_hash FROM p")
def content_rules(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", X.cleaned(F.col("html")).alias("t"))
    n = F.length("t")
    return rows.select("page_id", n.alias("size"), F.when(n < 900, "Very short content").when(n < 1800, "Limited content length").otherwise("ok").alias("issue"), X.sha256(F.col("t")).alias("content_hash"))


@query("SELECT url AS address, '<url><loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc><priority>' || CASE depth WHEN 0 THEN '1.0' WHEN 1 THEN '0.8' WHEN 2 THEN '0.6' ELSE '0.4' END || '</priority><changefreq>' || CASE depth WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END || '</changefreq></url>' AS xml FROM p WHERE status = 200 ORDER BY address")
def sitemap_lines(spark, sf_dir):
    ctx = pages(spark, sf_dir).select(F.col("url").alias("address"), "depth", F.col("status").alias("http_status"), F.lit(None).cast("timestamp").alias("last_crawled"), F.lit(True).alias("internal"), F.lit(True).alias("is_indexable"), F.lit(True).alias("has_html"))
    return report.sitemap_xml(ctx)


@query("SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.h, y.h)) AS distance FROM (SELECT doc_id, (doc_id * 2654435761 % 4294967296) // 4096 * 64 AS h FROM documents) x JOIN (SELECT doc_id, (doc_id * 2654435761 % 4294967296) // 4096 * 64 AS h FROM documents) y ON x.h < y.h AND bit_count(xor(x.h, y.h)) BETWEEN 1 AND 2")
def near_hash_pairs(spark, sf_dir):
    """The join of near hashes on synthetic ones, against all pairs. These lie in 20 of 64 bits: pairs grow with the square of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr("(doc_id * 2654435761 % 4294967296) div 4096 * 64").alias("hash"), F.lit(1).alias("project_id"))
    pairs, few = dup_rules.near_pairs(docs), docs.count() <= BROADCAST
    a, b = (F.broadcast(x) if few else x for x in (docs.select(F.col("doc_id").alias(x), F.col("hash").alias(f"h{x}")) for x in "ab"))
    return pairs.join(a.withColumnRenamed("a", "doc_a"), F.col("a") == F.col("ha")).join(b.withColumnRenamed("b", "doc_b"), F.col("b") == F.col("hb")).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), F.col("distance").cast("tinyint").alias("distance"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def kept_checkpoints(spark, sf_dir):
    from siteloom.streaming import frontier

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("created"), F.col("turn").alias("checkpoint_id"), "role")
    return frontier.kept_checkpoints(rows).select(F.col("project_id").alias("conv_id"), F.col("created").alias("turn"), "role")


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's findings as stored report rows, the clock left out."""
    return report.stored(registry.default().run(planted.crawl(spark, sf_dir)), F.lit(None).cast("timestamp"))


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser finds on each page, nested columns counted."""
    ctx = base.pages(O.crawl(spark, sf_dir))
    counted: list[Column] = [F.size(c).alias(f"n_{c}") for c in ("metas", "headings", "anchors", "images", "scripts", "stylesheets", "jsonld")]
    return ctx.select("url_id", "title", "html_lang", "body_length", "main_length", *counted)


QUERIES |= {"all_findings": all_findings, "page_features": page_features}


def queries() -> dict[str, Query]:
    from siteloom.plans import tasks

    return QUERIES | tasks.QUERIES


def oracle_sql() -> dict[str, str]:
    from siteloom.plans import tasks

    return ORACLES | tasks.ORACLES

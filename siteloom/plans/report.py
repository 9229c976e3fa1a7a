"""The report layer: rows as stored, searched, sorted, paged, summarised and exported."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom import model
from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import base
from siteloom.plans.workbook import write as write_workbook

ISSUE_SIZE = 512
KINDS = {"String": "string", "Integer": "bigint", "Decimal": "decimal(38,9)", "DateTime": "timestamp", "Boolean": "boolean", "Url": "string"}


@dataclass(frozen=True)
class ReportSchema:
    """Typed columns of a task's report; Severity comes first, names are unique, one column may be primary."""

    task_key: str
    columns: tuple[tuple[str, str], ...] = ()
    primary: str | None = None
    is_aggregate: bool = False
    version: int = 1
    options: dict = field(default_factory=dict, compare=False)

    def add(self, name: str, kind: str = "String", primary: bool = False, **options) -> ReportSchema:
        if kind not in KINDS:
            raise ValueError(f"no column type {kind}")
        if name.lower() in ("severity", *(n.lower() for n, _ in self.columns)):
            raise ValueError(f"column {name} is there already")
        return replace(self, columns=(*self.columns, (name, kind)), primary=name if primary else self.primary, options=self.options | {name: options})

    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(["Severity string", *(f"`{n}` {KINDS[k]}" for n, k in self.columns)]))


def synced(stored: dict[str, ReportSchema], wanted: list[ReportSchema]) -> dict[str, ReportSchema]:
    """Schemas created, or raised by one version where their columns differ."""
    out = dict(stored)
    for s in wanted:
        old = out.get(s.task_key)
        if old is None:
            out[s.task_key] = s
        elif (old.columns, old.primary, old.is_aggregate) != (s.columns, s.primary, s.is_aggregate):
            out[s.task_key] = replace(s, version=old.version + 1)
    return out


def severity_of(value: Column) -> Column:
    """A number or name as severity; null where it is neither."""
    named = F.lower(F.trim(value.cast("string")))
    number = named.try_cast("int")
    return F.when(number.between(0, 2), number).when(named == "error", 0).when(named == "warning", 1).when(named == "info", 2)


def issue_text(row: Column) -> Column:
    """The first that is not blank of Issue, Message, Description and Explanation of a row's JSON, cut to 512."""
    return F.substring(F.coalesce(*(F.nullif(F.trim(F.get_json_object(row, f"$.{n}")), F.lit("")) for n in ("Issue", "Message", "Description", "Explanation"))), 1, ISSUE_SIZE)


def stored(found: DataFrame, created: Column | None = None) -> DataFrame:
    """Findings as report rows: JSON without nulls, and ids that do not depend on partitions."""
    values = F.map_concat(F.map_filter("fields", lambda k, v: v.isNotNull()), F.map_from_entries(F.filter(F.array(F.struct(F.lit("Issue").alias("k"), F.col("issue").alias("v")), F.struct(F.lit("Explanation").alias("k"), F.nullif(F.col("explanation"), F.lit("")).alias("v"))), lambda e: e["v"].isNotNull())))
    rows = found.select(F.xxhash64("project_id", "task_key", "url_id", "issue", F.to_json("fields")).alias("row_id"), "project_id", "task_key", "url_id", F.to_json(values).alias("row_json"), (created if created is not None else F.current_timestamp()).alias("created"), "severity")
    return rows.withColumn("issue_text", issue_text(F.col("row_json")))


def write(rows: DataFrame, path: str) -> None:
    """Rows by task and project; those that a run writes replace the same task's and project's of an earlier run, and others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_key", "project_id").parquet(path)


def deleted(rows: DataFrame, project: int | None = None, task: str | None = None) -> DataFrame:
    """Rows but those of a project, of a task, or of a task of a project; with neither, none stays."""
    gone = F.lit(True)
    for column, value in (("project_id", project), ("task_key", task)):
        gone = gone & (F.col(column).eqNullSafe(value) if value is not None else F.lit(True))
    return rows.where(~gone)


def of_url(rows: DataFrame, url_id: int) -> DataFrame:
    """The findings of one page, by task in its priority and then severity."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in model.PRIORITY.items() for x in kv)), F.col("task_key")), F.lit(100))
    return rows.where(F.col("url_id") == url_id).orderBy(rank, "task_key", "severity", "issue_text", "row_id")


def counts(rows: DataFrame, by: str) -> DataFrame:
    """(by, n): how many rows each project, status, state, task or severity has."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def get(column: str, name: str, kind: str = "string") -> Column:
    """A typed value of a row's JSON; null where it is missing or of another type."""
    return F.get_json_object(F.col(column), f"$.{name}").try_cast(kind)


@dataclass(frozen=True)
class ReportQuery:
    """A grid's query as a plan: search, severity, order and page; nothing runs until rows are asked for."""

    rows: DataFrame
    addresses: DataFrame | None = None
    task: str | None = None
    text: str | None = None
    wanted: int | None = None
    order: str = ""
    descending: bool = False

    def for_task(self, task: str) -> ReportQuery:
        return replace(self, task=task)

    def search(self, text: str | None) -> ReportQuery:
        return replace(self, text=(text or "").strip() or None)

    def severity(self, value: int | None) -> ReportQuery:
        return replace(self, wanted=value)

    def sort(self, order: str, descending: bool = False) -> ReportQuery:
        return replace(self, order=order, descending=descending)

    def filtered(self) -> DataFrame:
        out = self.rows if self.task is None else self.rows.where(F.col("task_key") == self.task)
        if self.wanted is not None:
            out = out.where(F.col("severity") == self.wanted)
        if self.text is not None:
            has = lambda c: F.coalesce(F.contains(F.col(c), F.lit(self.text)), F.lit(False))
            if self.addresses is None:
                return out.where(has("row_json") | has("issue_text"))
            out = out.join(self.addresses.select("url_id", "address"), "url_id", "left")
            out = out.where(has("row_json") | has("issue_text") | has("address")).drop("address")
        return out

    def ordered(self) -> DataFrame:
        way = F.desc if self.descending else F.asc
        null_last = F.coalesce("severity", F.lit(-(2**31) if self.descending else 2**31 - 1))
        keys = {"created": ["created", "row_id"], "issue": [F.coalesce("issue_text", F.lit("")), "row_id"], "severity": [null_last, "row_id"]}.get(self.order.lower(), [null_last, F.coalesce("issue_text", F.lit("")), "row_id"])
        return self.filtered().orderBy(*(way(k) if isinstance(k, str) else (k.desc() if self.descending else k.asc()) for k in keys))

    def page(self, number: int = 0, size: int = 100) -> DataFrame:
        size = size if size > 0 else 100
        return self.ordered().offset(max(0, number) * size).limit(size)

    def count(self) -> int:
        return self.filtered().count()


def summary(rows: DataFrame) -> DataFrame:
    """Counts of each task by severity, and a total."""
    name = F.coalesce("task_key", F.lit("Total"))
    return rows.rollup("task_key").agg(F.count("*").alias("rows"), *(F.count_if(F.col("severity") == v).alias(k.lower() + "s") for k, v in model.SEVERITIES.items())).select(name.alias("task"), "rows", *(k.lower() + "s" for k in model.SEVERITIES))


def export_findings(found: DataFrame, path: str, tasks: list[str] | None = None, severities: list[int] | None = None) -> list[str]:
    """A CSV folder for each task's report and one of the summary; the names written."""
    rows = found if severities is None else found.where(F.col("severity").isin(severities))
    keys = sorted(tasks or [r.task_key for r in rows.select("task_key").distinct().collect()], key=lambda k: (model.PRIORITY.get(k, 100), k))
    for key in keys:
        shaped = base.shaped(rows, key) if key in model.REPORTS else rows.where(F.col("task_key") == key).drop("fields")
        shaped.orderBy("Severity", shaped.columns[3]).write.mode("overwrite").csv(f"{path}/{key}", header=True)
    summary(rows if tasks is None else rows.where(F.col("task_key").isin(tasks))).coalesce(1).write.mode("overwrite").csv(f"{path}/Summary", header=True)
    return [*keys, "Summary"]


def workbook(found: DataFrame, path: str, rules: DataFrame | None = None, tasks: list[str] | None = None, severities: list[int] | None = None) -> list[str]:
    """One workbook: a summary, a sheet for each task's report by severity, and, with ``rules``, extractions as a pivot of pages by rule; the names of the sheets."""
    from siteloom.operators import site_rules

    rows = found if severities is None else found.where(F.col("severity").isin(severities))
    rows = rows if tasks is None else rows.where(F.col("task_key").isin(tasks))
    keys = sorted((r.task_key for r in rows.select("task_key").distinct().collect()), key=lambda k: (model.PRIORITY.get(k, 100), k))
    sheets = {"Summary": summary(rows)}
    for key in keys:
        own = rows.where(F.col("task_key") == key)
        if key == "CustomExtraction" and rules is not None:
            sheets[key] = site_rules.pivot(own, rules).orderBy("Page")
        elif key in model.REPORTS:
            shaped = base.shaped(own, key)
            sheets[key] = shaped.drop("project_id", "url_id").orderBy(F.array_position(F.array(*(F.lit(x) for x in model.SEVERITIES)), F.col("Severity")), *shaped.columns[3:5])
        else:  # a task without a report of its own
            sheets[key] = own.select("page", "issue", "severity", "explanation").orderBy(F.desc("severity"), "page", "issue")
    return write_workbook(path, sheets)


STATES = ["Pending", "Crawling", "Completed", "Failed"]


def url_sheet(ctx: DataFrame) -> DataFrame:
    """URLs by address as a sheet shows them, in 52 columns: Yes, No or nothing, External at depth -1. What a browser alone tells (changes by script) is empty."""
    blank, low = F.lit(""), F.lower
    yes = lambda c: F.when(c, "Yes").otherwise("")
    either = lambda c: F.when(c, "Yes").when(~c, "No").otherwise("")
    shown = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), blank)
    when = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), blank)
    heads = {f"H{k}": F.array_join(F.transform(F.filter("headings", lambda h, k=k: h["level"] == k), lambda h: h["text"]), " | ") for k in range(1, 7)}
    several, cross = F.col("has_multiple_canonicals"), F.coalesce(U.is_external(F.col("address"), F.col("canonical")), F.lit(False))
    soft = low(F.coalesce("title", blank)).rlike("404|not found") & (F.col("http_status") == 200)
    source = F.concat_ws(", ", F.when(F.col("robots_meta").isNotNull(), "meta"), F.when(F.col("x_robots_tag").isNotNull(), "header"))
    flag = lambda name: either(F.when(F.col("has_html"), F.col(f"robots_{name}")))
    columns = {
        "Address": F.col("address"), "Status Code": F.coalesce("http_status", F.lit(0)), "Title": shown("title"), "Meta Description": shown(base.meta("description")), **{k: F.coalesce(v, blank) for k, v in heads.items()}, "Content Type": shown("content_type"), "Content Length": F.coalesce("content_length", F.lit(0)),
        "Depth": F.when(F.col("depth") < 0, "External").otherwise(F.col("depth").cast("string")), "Status": F.coalesce(F.get(F.array(*(F.lit(x) for x in STATES)), F.col("status").cast("int")), blank), "Scheme": U.scheme(F.col("address")), "Host": U.host(F.col("address")), "Path": U.path(F.col("address")),
        "Canonical (HTML)": shown("canonical_html"), "Canonical (HTTP)": shown("canonical_http"), "Has Multiple Canonicals": yes(several), "Has Cross-Domain Canonical": yes(cross), "Canonical Issues": F.concat_ws("; ", F.when(several, "several canonicals"), F.when(cross, "another domain")),
        "Robots Allowed": either(F.col("robots_allowed")), "Noindex": flag("noindex"), "Nofollow": flag("nofollow"), "Noarchive": flag("noarchive"), "Nosnippet": flag("nosnippet"), "Noimageindex": flag("noimageindex"), "Robots Source": source, "X-Robots-Tag": shown("x_robots_tag"), "Has Robots Conflict": yes(F.col("robots_conflict")), "Is Indexable": either(F.col("is_indexable")),
        "Redirect Target": shown("redirect_target"), "Is Redirect Loop": yes(F.col("is_redirect_loop")), "Redirect Chain Length": shown("redirect_chain_length") if "redirect_chain_length" in ctx.columns else blank, "Is Soft 404": yes(soft), "Has Meta Refresh": yes(F.col("refresh_target").isNotNull()), "Meta Refresh Delay": shown("refresh_delay"), "Meta Refresh Target": shown("refresh_target"),
        "Has JS Changes": blank, "JS Changed Elements": blank, "Cache-Control": shown(base.header("cache-control")), "Vary": shown(base.header("vary")), "Content-Encoding": shown(base.header("content-encoding")), "Link Header": shown(base.header("link")), "Has HSTS": yes(base.header("strict-transport-security").isNotNull()),
        "HTML Lang": shown("html_lang"), "Content-Language Header": shown(base.header("content-language")), "Content Hash": F.coalesce(X.sha256(F.col("visible")), blank), "SimHash": shown(F.when(F.col("visible").isNotNull(), X.simhash(F.col("visible")))), "First Seen": when("first_seen"), "Last Crawled": when("last_crawled"),
    }
    return ctx.select(*(v.alias(k) for k, v in columns.items())).orderBy("Address")


def found_in(wide: DataFrame, text: str | None = None, severity: int | None = None) -> DataFrame:
    """Rows of a pivot any of whose columns holds ``text``, whatever the case, and of a severity."""
    out = wide if severity is None else wide.where(F.col("Severity") == severity)
    wanted = (text or "").strip().lower()
    return out if not wanted else out.where(F.exists(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in wide.columns)), lambda v: F.contains(F.lower(v), F.lit(wanted))))


def overview(ctx: DataFrame, text: str | None = None) -> DataFrame:
    """URLs whose address, title or content type holds ``text``, whatever the case."""
    wanted = (text or "").strip().lower()
    return ctx if not wanted else ctx.where(" or ".join(f"contains(lower(coalesce({c}, '')), '{wanted.replace(chr(39), chr(39) * 2)}')" for c in ("address", "title", "content_type")))


def properties(ctx: DataFrame) -> DataFrame:
    """(url_id, key, value): each page's columns as a list."""
    own = ctx.select("url_id", *(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("address", "depth", "http_status", "content_type", "title", "html_lang", "canonical", "robots_meta", "is_indexable")))
    return own.unpivot("url_id", own.columns[1:], "key", "value")


def sitemap_xml(ctx: DataFrame) -> DataFrame:
    """(address, xml) of indexable pages fetched well, by address; lines of a sitemap."""
    depth, when = F.col("depth"), F.date_format("last_crawled", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("address"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    xml = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), when, F.lit("</lastmod>")), F.lit("")), F.lit("<priority>"), F.format_string("%.1f", X.sitemap_priority(depth)), F.lit("</priority><changefreq>"), X.change_frequency(depth), F.lit("</changefreq></url>"))
    return ctx.where(F.col("internal") & F.col("is_indexable") & (F.col("http_status") == 200) & F.col("has_html")).select("address", xml.alias("xml")).orderBy("address")


def export_sitemap(ctx: DataFrame, path: str) -> None:
    """One file, head and foot around the lines; there are at most 50 000."""
    lines = sitemap_xml(ctx).limit(50_000).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("address", "xml"))), lambda x: x["xml"]), "\n").alias("x"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    lines.select(F.concat(F.lit(head), F.col("x"), F.lit("\n</urlset>")).alias("value")).coalesce(1).write.mode("overwrite").text(path)

"""The crawl's tables and the columns of every report."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ERROR, WARNING, INFO = 0, 1, 2
SEVERITIES = {"Error": ERROR, "Warning": WARNING, "Info": INFO}
PENDING, CRAWLING, COMPLETED, FAILED = range(4)
LINK_TYPES = {0: "Hyperlink", 1: "Image", 2: "Script", 3: "Stylesheet", 4: "Other"}

TABLES = {
    "projects": "project_id int, name string, base_url string, user_agent string, max_depth int, max_urls int, respect_robots boolean, last_opened timestamp",
    "urls": "url_id long, project_id int, address string, depth int, status tinyint, http_status int, content_type string, content_length long, first_seen timestamp, last_crawled timestamp, robots_allowed boolean, redirect_target string, is_redirect_loop boolean",
    "page_html": "url_id long, project_id int, address string, html string",
    "headers": "url_id long, name string, value string, seq int",
    "links": "project_id int, from_url_id long, to_url_id long, anchor_text string, link_type tinyint, rel string, is_nofollow boolean, is_ugc boolean, is_sponsored boolean, dom_path string",
    "redirects": "url_id long, from_url string, to_url string, status_code int, position int",
    "robots_txt": "host string, content string",
    "sitemaps": "url string, content string",
    "external_status": "url string, user_agent string, status int, response_seconds double, failure string",
    "variant_probe": "project_id int, variant_url string, status int, location string, failure string",
    "extraction_rules": "rule_id int, project_id int, name string, field_name string, selector_type int, selector string, is_enabled boolean",
    "frontier": "project_id int, address string, priority int, depth int, host_key string, enqueued timestamp, state tinyint",
    "checkpoints": "project_id int, checkpoint_id long, phase string, urls_crawled long, errors long, queue_size long, last_url string, created timestamp, is_active boolean",
    "report_rows": "row_id long, project_id int, task_key string, url_id long, row_json string, created timestamp, severity int, issue_text string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


@dataclass
class Crawl:
    """One or more projects' tables; what is not given is empty."""

    spark: SparkSession
    projects: DataFrame | None = None
    urls: DataFrame | None = None
    page_html: DataFrame | None = None
    headers: DataFrame | None = None
    links: DataFrame | None = None
    redirects: DataFrame | None = None
    robots_txt: DataFrame | None = None
    sitemaps: DataFrame | None = None
    external_status: DataFrame | None = None
    variant_probe: DataFrame | None = None
    extraction_rules: DataFrame | None = None
    features: DataFrame | None = field(default=None)

    def __post_init__(self):
        for f in fields(self):
            if f.name in TABLES and getattr(self, f.name) is None:
                setattr(self, f.name, self.spark.createDataFrame([], schema(f.name)))


#: Column -> type of each task's report; the first is the page that rows belong to unless PRIMARY names another.
REPORTS: dict[str, dict[str, str]] = {
    "BrokenLinks": {"Issue": "string", "LinkedFrom": "string", "BrokenLink": "string", "Status": "string", "LinkText": "string", "LinkType": "string", "IsExternal": "string", "Occurrences": "int"},
    "Canonical": {"Page": "string", "Issue": "string", "CanonicalURL": "string", "Status": "string"},
    "CrawlBudget": {"Page": "string", "Issue": "string", "Details": "string", "StatusCode": "int", "Depth": "int"},
    "CustomExtraction": {"Page": "string", "RuleName": "string", "ExtractedValue": "string", "Selector": "string", "Count": "int"},
    "DuplicateContent": {"Page": "string", "Issue": "string", "DuplicateOf": "string", "Similarity": "int"},
    "Hreflang": {"Page": "string", "Issue": "string", "HreflangTag": "string", "TargetURL": "string"},
    "ImageAudit": {"ImageURL": "string", "Page": "string", "Issue": "string", "AltText": "string", "FileSize": "int"},
    "InternalLinking": {"Page": "string", "IssueType": "string", "FromURL": "string", "ToURL": "string", "AnchorText": "string", "Inlinks": "int", "Outlinks": "int", "Depth": "int"},
    "Inventory": {"URL": "string", "Issue": "string", "ContentType": "string", "Status": "int", "Depth": "int", "Indexable": "string"},
    "LinkGraph": {"Issue": "string", "FromURL": "string", "ToURL": "string", "AnchorText": "string", "LinkType": "string"},
    "Redirects": {"Source": "string", "Target": "string", "StatusCode": "int", "Issue": "string"},
    "Robots": {"Page": "string", "Issue": "string", "RobotsMeta": "string", "XRobotsTag": "string", "Indexable": "string"},
    "Security": {"Page": "string", "Issue": "string", "Protocol": "string", "Details": "string"},
    "Sitemap": {"URL": "string", "Issue": "string", "InSitemap": "string", "StatusCode": "int"},
    "StructuredData": {"Page": "string", "SchemaType": "string", "Issue": "string", "Property": "string"},
    "TitlesMeta": {"Page": "string", "Issue": "string", "Title": "string", "MetaDescription": "string", "Length": "int"},
}
PRIMARY = {"BrokenLinks": "LinkedFrom", "LinkGraph": "FromURL"}
#: Order in which tasks report.
PRIORITY = {"Inventory": 10, "Security": 15, "Robots": 20, "Redirects": 20, "Canonical": 25, "TitlesMeta": 30, "Hreflang": 35, "InternalLinking": 40, "Sitemap": 45, "DuplicateContent": 50, "BrokenLinks": 50, "CrawlBudget": 55, "ImageAudit": 60, "StructuredData": 60, "CustomExtraction": 70, "LinkGraph": 1000}

"""Tasks by name, in order of priority; a task that fails does not stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from siteloom.model import PRIORITY, Crawl
from siteloom.operators import base, dup_rules, graph_rules, page_rules, site_rules
from siteloom.plans.lineage import checkpoint

Task = Callable[..., DataFrame]


@dataclass(frozen=True)
class Exporter:
    key: str
    name: str
    extension: str
    write: Callable[[DataFrame, str], None]


@dataclass
class Registry:
    """Where tasks, exporters and report schemas are registered; all tasks are enabled unless named otherwise."""

    tasks: dict[str, tuple[int, Task]]
    disabled: frozenset[str] = frozenset()
    exporters: dict[str, Exporter] = field(default_factory=dict)
    schemas: dict[str, object] = field(default_factory=dict)

    def register(self, key: str, task: Task, priority: int = 100) -> None:
        """``task(crawl, ctx) -> rows``; a key can be taken once."""
        if key in self.tasks:
            raise ValueError(f"task {key} is registered already")
        self.tasks[key] = (priority, task)

    def register_exporter(self, key: str, name: str, extension: str, write: Callable[[DataFrame, str], None]) -> None:
        """``write(findings, path)``; a key can be taken once."""
        if key in self.exporters:
            raise ValueError(f"exporter {key} is registered already")
        self.exporters[key] = Exporter(key, name, extension, write)

    def export(self, key: str, found: DataFrame, path: str) -> str:
        """Write findings by a registered exporter; the path written, with its extension."""
        own = self.exporters[key]
        place = path if path.endswith(own.extension) else path + own.extension
        own.write(found, place)
        return place

    def register_schema(self, schema) -> None:
        """A task's report schema (``plans.report.ReportSchema``); one that is there is replaced."""
        self.schemas[schema.task_key] = schema

    def ordered(self) -> list[tuple[str, Task]]:
        return [(k, t) for k, (p, t) in sorted(self.tasks.items(), key=lambda x: (x[1][0], x[0])) if k not in self.disabled]

    def run(self, crawl: Crawl, only: list[str] | None = None, completed_only: bool = False, isolated: bool = False) -> DataFrame:
        """The findings of all tasks as one DataFrame. A task whose plan cannot be built is logged and left out.

        ``isolated``: each task also runs here, and its findings are written, so that one that fails while it runs is left out as well and the others are kept; that costs a job for each task.
        """
        chosen = [(k, t) for k, t in self.ordered() if only is None or k in only]
        ctx = checkpoint(base.pages(crawl, completed_only))  # pages are parsed once, however often tasks read them
        parts = []
        for key, task in chosen:
            try:
                found = task(crawl, ctx).select(base.ROW)
                parts.append(checkpoint(found) if isolated else found)
            except Exception:
                logging.getLogger(__name__).exception("task %s failed", key)
        return graph_rules.union_all(parts) if parts else crawl.spark.createDataFrame([], base.ROW_SCHEMA)


def default(disabled: frozenset[str] = frozenset()) -> Registry:
    tasks = {
        "Inventory": page_rules.inventory, "Security": page_rules.security, "Robots": page_rules.robots, "Redirects": graph_rules.redirects, "Canonical": graph_rules.canonical, "TitlesMeta": page_rules.titles,
        "Hreflang": page_rules.hreflang, "InternalLinking": graph_rules.internal_linking, "Sitemap": site_rules.sitemap, "DuplicateContent": dup_rules.duplicates, "BrokenLinks": graph_rules.broken_links,
        "CrawlBudget": page_rules.crawl_budget, "ImageAudit": page_rules.images, "StructuredData": site_rules.structured_data, "CustomExtraction": site_rules.extraction, "LinkGraph": graph_rules.link_graph,
    }
    return Registry({k: (PRIORITY[k], t) for k, t in tasks.items()}, disabled)

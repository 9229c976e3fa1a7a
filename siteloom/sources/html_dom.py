"""Pages parsed once: one pass of a tolerant parser gives every task its columns.

Map-only; the parsed features hold no markup, so that tasks never read it again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteloom.plans.lineage import bounded, tidy

#: Bytes for each core below which a table of pages is spread before it is parsed.
SPREAD = 32 << 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "svg", "iframe"))
FURNITURE = frozenset(("header", "footer", "nav", "aside", "sidebar"))
FURNITURE_ROLES = frozenset(("navigation", "banner", "contentinfo"))
#: Tags that carry resources, and the attribute that names them.
RESOURCES = {"img": "src", "script": "src", "iframe": "src", "video": "src", "audio": "src", "source": "src", "object": "data"}
SCHEMA = """url_id long, title string, html_lang string, base_href string,
metas array<struct<name: string, content: string>>, viewports int, charsets array<string>, headings array<struct<level: int, text: string>>,
anchors array<struct<at: int, href: string, url: string, text: string, rel: string>>, canonicals array<string>,
alternates array<struct<code: string, href: string, url: string>>, stylesheets array<struct<href: string, url: string>>, scripts array<struct<src: string, url: string, body: string>>,
images array<struct<at: int, src: string, url: string, srcset: string, loading: string, alt: string, title: string, width: int, height: int>>,
resources array<struct<kind: string, url: string>>, ids array<string>, itemtypes array<string>, has_itemscope boolean, jsonld array<string>,
has_article boolean, has_rel_author boolean, body string, visible string, body_length int, main_length int"""
NAMES = re.findall(r"(?:^|, ?|\n)(\w+) (?:long|string|int|boolean|array)", SCHEMA)


def squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def number(value: str | None) -> int | None:
    found = re.match(r"\s*(\d{1,9})\s*(?:px)?\s*$", value or "")
    return int(found[1]) if found else None


def joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return href


class Page(HTMLParser):
    """Collects a page's features; unclosed and stray tags are tolerated."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=False)
        self.url = self.base = url
        self.found: dict = {n: [] for n in NAMES} | {"url_id": None, "title": None, "html_lang": None, "base_href": None, "viewports": 0, "has_itemscope": False, "has_article": False, "has_rel_author": False}
        self.open: list[tuple[str, bool, bool]] = []  # tag, hidden, furniture
        self.texts: dict[str, list[str]] = {}
        self.in_body = False
        self.body: list[str] = []
        self.main: list[str] = []
        self.seen: list[str] = []
        self.anchor: tuple[dict, list[str]] | None = None
        self.heading: tuple[int, list[str]] | None = None
        self.script: tuple[dict, list[str]] | None = None
        self.title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, f = {}, self.found
        for k, v in attrs:
            a.setdefault(k, unescape(v) if v else "")
        if tag == "body":
            self.in_body = True
        for k in ("id", "name"):
            if a.get(k) and (k == "id" or tag == "a"):
                f["ids"].append(a[k])
        if "itemscope" in a:
            f["has_itemscope"] = True
            if a.get("itemtype"):
                f["itemtypes"].append(a["itemtype"])
        rel = a.get("rel", "").lower().split()
        if tag == "html" and f["html_lang"] is None:
            f["html_lang"] = a.get("lang", "").strip() or None
        elif tag == "base" and f["base_href"] is None and a.get("href"):
            f["base_href"] = a["href"]
            self.base = joined(self.url, a["href"])
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()
            if name:
                f["metas"].append({"name": name, "content": a.get("content", "")})
            f["viewports"] += name == "viewport"
            if a.get("charset"):
                f["charsets"].append(a["charset"].strip())
            elif name == "content-type" and (m := re.search(r"charset=([^\s;]+)", a.get("content", ""), re.I)):
                f["charsets"].append(m[1])
        elif tag == "link" and a.get("href"):
            url = joined(self.base, a["href"])
            if "canonical" in rel:
                f["canonicals"].append(url)
            if "alternate" in rel and a.get("hreflang"):
                f["alternates"].append({"code": a["hreflang"].strip(), "href": a["href"], "url": url})
            if "stylesheet" in rel:
                f["stylesheets"].append({"href": a["href"], "url": url})
                f["resources"].append({"kind": "stylesheet", "url": url})
        elif tag == "a" and "href" in a:
            self.close_anchor()
            self.anchor = ({"at": len(f["anchors"]), "href": a["href"].strip(), "url": joined(self.base, a["href"]), "rel": a.get("rel", "")}, [])
        elif tag == "img":
            f["images"].append({"at": len(f["images"]), "src": a.get("src", "").strip(), "url": joined(self.base, a["src"]) if a.get("src") else "", "srcset": a.get("srcset", ""), "loading": a.get("loading", ""), "alt": a.get("alt", ""), "title": a.get("title", ""), "width": number(a.get("width")), "height": number(a.get("height"))})
            if self.anchor:
                self.anchor[1].append(a.get("alt", ""))
        elif tag == "script":
            self.script = ({"src": a.get("src") or None, "url": joined(self.base, a["src"]) if a.get("src") else None, "type": a.get("type", "").lower()}, [])
        elif re.fullmatch("h[1-6]", tag):
            self.heading = (int(tag[1]), [])
        elif tag == "title" and f["title"] is None and self.title is None and not any(t == "svg" for t, *_ in self.open):
            self.title = []
        elif tag == "article":
            f["has_article"] = True
        if tag in ("a", "link") and "author" in rel:
            f["has_rel_author"] = True
        if tag in RESOURCES and a.get(RESOURCES[tag]):
            f["resources"].append({"kind": {"img": "image"}.get(tag, tag), "url": joined(self.base, a[RESOURCES[tag]])})
        if tag not in VOID:
            hidden, furniture = any(h for _, h, _ in self.open[-1:]), any(x for _, _, x in self.open[-1:])
            self.open.append((tag, hidden or tag in HIDDEN, furniture or tag in FURNITURE or a.get("role", "").lower() in FURNITURE_ROLES))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_anchor(self) -> None:
        if self.anchor:
            about, text = self.anchor
            self.found["anchors"].append(about | {"text": squeezed(text)})
            self.anchor = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.close_anchor()
        elif tag == "script" and self.script:
            about, body = self.script
            if about.pop("type") == "application/ld+json":
                self.found["jsonld"].append("".join(body).strip())
            self.found["scripts"].append(about | {"body": "".join(body)})
            self.script = None
        elif re.fullmatch("h[1-6]", tag) and self.heading:
            self.found["headings"].append({"level": self.heading[0], "text": squeezed(self.heading[1])})
            self.heading = None
        elif tag == "title" and self.title is not None:
            self.found["title"] = squeezed(self.title)
            self.title = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.script:
            self.script[1].append(data)
        if self.title is not None:
            self.title.append(data)
        hidden, furniture = (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)
        if self.anchor and not hidden:
            self.anchor[1].append(data)
        if self.heading and not hidden:
            self.heading[1].append(data)
        if self.in_body:
            self.body.append(data)
            if not furniture:
                self.main.append(data)
            if not hidden:
                self.seen.append(data + " ")

    def handle_entityref(self, name: str) -> None:
        self.handle_data(unescape(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.handle_data(unescape(f"&#{name};"))

    def done(self) -> dict:
        self.close()
        self.close_anchor()
        if self.script:
            self.handle_endtag("script")
        f = self.found
        body = "".join(self.body)
        f |= {"body": body.strip(), "visible": squeezed(self.seen), "body_length": len(squeezed(self.body)), "main_length": len(squeezed(self.main))}
        return f


def parse(url: str, html: str) -> dict:
    page = Page(url or "")
    page.feed(html or "")
    return page.done()


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes a plan's size for; a plan without statistics counts as very large."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def features(urls: DataFrame, page_html: DataFrame) -> DataFrame:
    """One row (SCHEMA) for each page with markup: map-only over (url_id, address, html). A table of less than SPREAD bytes a core is spread over all cores first; beyond that the scan splits it and its
    markup is never shuffled. A table without an address column takes it from ``urls``, by a join that does move the markup."""
    struct = T.StructType.fromDDL(re.sub(r"\s+", " ", SCHEMA))
    kinds = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pylist()
                yield from pa.Table.from_pylist([parse(r["address"], r["html"]) | {"url_id": r["url_id"]} for r in rows], kinds).combine_chunks().to_batches()
            tidy()

    bounded(page_html.sparkSession)
    pages, cores = page_html.where("html is not null and trim(html) != ''"), page_html.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(page_html) < cores * SPREAD:
        pages = pages.repartition(cores, "url_id")
    if "address" not in pages.columns:
        pages = pages.join(urls.select("url_id", "address"), "url_id")
    return pages.select("url_id", "address", "html").mapInArrow(run, struct)


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def selected(html: str, selector: str, kind: int) -> list[str]:
    """Texts that a CSS (0) or XPath (1) selector of the supported subset finds, or a pattern's first groups (2)."""
    if kind == 2:
        return [(m[1] if m.re.groups else m[0]) for m in re.finditer(selector, html, re.I)]
    return [t for t in (n.text().strip() for n in select(tree(html), css_steps(selector) if kind == 0 else xpath_steps(selector))) if t]


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag: str) -> None:
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def tree(html: str) -> Node:
    parser = Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def css_steps(selector: str) -> list[list[tuple]]:
    """Alternatives of steps (direct child?, tag, conditions): tags, #id, .class, [attribute], [attribute=value], and ^= $= *= ~=, ``>`` and blanks between."""
    out = []
    for alternative in selector.split(","):
        steps, direct = [], False
        for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", alternative.strip()):
            if token == ">":
                direct = True
                continue
            m = re.match(r"[\w*-]*", token)
            rest, tests = token[m.end() :], []
            for kind, name, attribute, op, value in re.findall(r"([#.])([\w-]+)|\[([\w:-]+)(?:([~^$*]?=)[\"']?([^\"'\]]*)[\"']?)?\]", rest):
                tests.append(("id", "=", name) if kind == "#" else ("class", "~=", name) if kind else (attribute, op or "has", value))
            if re.sub(r"[#.][\w-]+|\[[^\]]*\]", "", rest):
                raise ValueError(f"selector {selector}")
            steps.append((direct, m[0] or "*", tests, None))
            direct = False
        if not steps:
            raise ValueError(f"selector {selector}")
        out.append(steps)
    return out


def xpath_steps(selector: str) -> list[list[tuple]]:
    """Paths of ``/`` and ``//`` steps with [@a], [@a='v'], [contains(@a,'v')] and [n]."""
    out = []
    for alternative in selector.split("|"):
        steps, at = [], 0
        text = alternative.strip()
        while at < len(text):
            m = re.compile(r"(//?)([\w*-]+)((?:\[[^\]]*\])*)").match(text, at)
            if not m:
                raise ValueError(f"path {selector}")
            tests, position = [], None
            for t in re.findall(r"\[([^\]]*)\]", m[3]):
                if t.isdigit():
                    position = int(t)
                elif c := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"']([^\"']*)[\"'])?", t):
                    tests.append((c[1], "has" if c[2] is None else "=", c[2] or ""))
                elif c := re.fullmatch(r"contains\(\s*@([\w:-]+)\s*,\s*[\"']([^\"']*)[\"']\s*\)", t):
                    tests.append((c[1], "*=", c[2]))
                else:
                    raise ValueError(f"path {selector}")
            steps.append((m[1] == "/", m[2], tests, position))
            at = m.end()
        out.append(steps)
    return out


TESTS = {"has": lambda a, v: True, "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "*=": lambda a, v: v in a}


def select(root: Node, alternatives: list[list[tuple]]) -> list[Node]:
    found: dict[int, Node] = {}
    for steps in alternatives:
        now = [root]
        for direct, tag, tests, position in steps:
            following: dict[int, Node] = {}
            for node in now:
                own = [c for c in (node.children if direct else node.walk()) if isinstance(c, Node) and tag in ("*", c.tag) and all(a in c.attrs and TESTS[op](c.attrs[a], v) for a, op, v in tests)]
                following |= {id(c): c for c in (own[position - 1 : position] if position else own)}
            now = list(following.values())
        found |= {id(n): n for n in now}
    order = {id(n): i for i, n in enumerate(root.walk())}
    return sorted(found.values(), key=lambda n: order[id(n)])


def extractions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_id, rule_id, values, failure) of pages (url_id, project_id, html) crossed with enabled rules; a page is parsed once for all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, html, own in zip(batch.url_id, batch.html, batch.rules, strict=True):
                root = None
                for rule in own:
                    try:
                        kind, selector = rule["selector_type"], rule["selector"]
                        if kind == 2:
                            values = selected(html, selector, kind)
                        else:
                            root = root or tree(html)
                            values = [t for t in (n.text().strip() for n in select(root, css_steps(selector) if kind == 0 else xpath_steps(selector))) if t]
                        rows.append((i, rule["rule_id"], values, None))
                    except (re.error, ValueError) as e:
                        rows.append((i, rule["rule_id"], None, str(e)))
            yield pd.DataFrame(rows, columns=["url_id", "rule_id", "values", "failure"])

    gathered = rules.where("is_enabled").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "selector_type", "selector"))).alias("rules"))
    rules = F.broadcast(gathered) if estimated_bytes(gathered) <= SPREAD else gathered
    return pages.join(rules, "project_id").select("url_id", "html", "rules").mapInPandas(run, "url_id long, rule_id int, values array<string>, failure string")

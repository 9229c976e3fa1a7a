"""Workbooks read back, the URL sheet's columns, pivot search and the simulated crawl."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile

from crawl_data import crawl, page

from siteloom import model
from siteloom.operators import base, graph_rules, registry
from siteloom.plans import report, workbook

A, N = "https://www.a.com", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read(path: str) -> dict[str, list[list]]:
    with zipfile.ZipFile(path) as book:
        names = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{N}sheet")]
        out = {}
        for i, name in enumerate(names, 1):
            rows = ET.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{N}row")
            out[name] = [[(c.findtext(f"{N}is/{N}t") if c.get("t") else c.findtext(f"{N}v")) for c in r] for r in rows]
        assert {"[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"} <= set(book.namelist())
    return out


def test_cells_names_and_long_sheets(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.5, True, "a<b>\x00&", None), (2, None, False, "", "x"), (3, 2.0, None, "y", "z")], "n int, d double, b boolean, s string, t string").coalesce(1)
    names = workbook.write(str(tmp_path / "x.xlsx"), {"A name that is longer than thirty-one characters": rows, "A/b": rows, "a_B": rows.limit(0)}, most=3)
    found = read(str(tmp_path / "x.xlsx"))
    assert list(found) == names and len(set(map(str.lower, names))) == len(names) and all(len(n) <= 31 for n in names)
    first, second = found[names[0]], found[names[1]]
    assert first == [["n", "d", "b", "s", "t"], ["1", "1.5", "Yes", "a<b>&", None], ["2", None, "No", "", "x"]] or first[1][3] == "a<b>&"
    assert second[1][:2] == ["3", "2.0"] and len(first) == 3


def test_findings_workbook(spark, tmp_path):
    c = crawl(spark, [{"url": f"{A}/1", "html": page(title="")}, {"url": f"{A}/2_x", "html": page()}], rules=[(1, 1, "Head", "head", 0, "h1", True)])
    found = registry.default().run(c, ["Inventory", "TitlesMeta", "CustomExtraction"])
    names = report.workbook(found, str(tmp_path / "f.xlsx"), c.extraction_rules)
    sheets = read(str(tmp_path / "f.xlsx"))
    assert names == ["Summary", "Inventory", "TitlesMeta", "CustomExtraction"] == list(sheets)
    assert sheets["TitlesMeta"][0] == ["Severity", *model.REPORTS["TitlesMeta"], "Explanation"] and sheets["TitlesMeta"][1][:3] == ["Error", f"{A}/1", "Missing Title"]
    assert sheets["CustomExtraction"][0] == ["Page", "Severity", "Head"] and len(sheets["CustomExtraction"]) == 3
    wide = report.found_in(spark.createDataFrame([("p", 0, "Boats"), ("q", 1, "x")], "Page string, Severity int, Head string"), "boat")
    assert [x.Page for x in wide.collect()] == ["p"] and report.found_in(wide, None, 1).count() == 0


def test_url_sheet_has_all_columns(spark):
    c = crawl(spark, [{"url": f"{A}/1", "html": page()}, {"url": f"{A}/2", "status": 404}], headers=[(1, "Strict-Transport-Security", "max-age=1"), (1, "X-Robots-Tag", "noindex")])
    sheet = report.url_sheet(base.pages(c))
    one, two = sheet.collect()
    assert len(sheet.columns) == 52 and one["Has HSTS"] == "Yes" and one["Noindex"] == "Yes" and one["Robots Source"] == "header" and two["Noindex"] == "" and one["Status"] == "Completed"
    assert one["SimHash"] not in ("", "0") and two["Content Hash"] == ""


def test_simulated_crawl(spark):
    edges = spark.createDataFrame([("a", "b", False), ("a", "c", False), ("a", "out", True), ("b", "d", False), ("c", "e", False), ("d", "f", False), ("out", "g", False)], "source string, target string, external boolean")
    starts, barred = spark.createDataFrame([("a",)], "address string"), spark.createDataFrame([("c",)], "address string")
    found = {x.address: (x.depth, x.state) for x in graph_rules.simulated(starts, edges, 2, 10, barred).collect()}
    assert found == {"a": (0, "fetched"), "b": (1, "fetched"), "c": (1, "barred"), "out": (-1, "external"), "d": (2, "fetched")}
    assert {x.address: x.state for x in graph_rules.simulated(starts, edges, 1, 2).collect()} == {"a": "fetched", "b": "fetched", "c": "queued", "out": "external"}

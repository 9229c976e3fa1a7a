"""Workbooks (Office Open XML) of bounded sheets, written by the standard library: typed cells, streamed row by row.

A workbook is for people to read: rows come to the driver one partition at a time and are never held together. A sheet ends at the format's limit of rows and is carried on in the next.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a sheet, its header among them, and characters of a cell.
ROWS, CHARACTERS = 1_048_576, 32_767
_MAIN, _REL, _TYPES = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def cell(value) -> str:
    """Numbers as numbers, booleans as Yes or No, times as text, null as an empty cell."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        value = "Yes" if value else "No"
    elif isinstance(value, (int, float, Decimal)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value}</v></c>"
    elif isinstance(value, datetime.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value))[:CHARACTERS])}</t></is></c>'


def row(values) -> bytes:
    return f"<row>{''.join(map(cell, values))}</row>".encode()


def names(wanted: str, taken: set[str]) -> Iterator[str]:
    """A sheet's name and those it is carried on under: at most 31 characters, without signs that the format forbids, unique whatever the case."""
    base, n = re.sub(r"[\[\]:*?/\\]", "_", wanted)[:31] or "Sheet", 1
    while True:
        name = base if n == 1 else f"{base[: 28 - len(str(n))]} ({n})"
        n += 1
        if name.lower() not in taken:
            taken.add(name.lower())
            yield name


def write(path: str, sheets: dict[str, DataFrame], most: int = ROWS) -> list[str]:
    """Write the sheets in order to a local file; the names they have there."""
    done: list[str] = []
    taken: set[str] = set()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:

        def sheet(name: str, header: list[str], rows: Iterator) -> bool:
            """Whether rows may be left."""
            done.append(name)
            with book.open(f"xl/worksheets/sheet{len(done)}.xml", "w", force_zip64=True) as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode() + row(header))
                for n, values in enumerate(rows, 2):
                    out.write(row(values))
                    if n == most:
                        break
                else:
                    n = 0
                out.write(b"</sheetData></worksheet>")
            return n == most

        for wanted, df in sheets.items():
            rows, own = df.toLocalIterator(prefetchPartitions=True), names(wanted, taken)
            while sheet(next(own), df.columns, rows):
                pass
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(done, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(done) + 1)) + "</Relationships>")
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{package}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(done) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
    return done

"""Workbooks (.xlsx) as grids of text, and grids as workbooks, by zip and XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Fixed values of the format: number formats that are dates, and the first day of its calendar.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
DAY_ZERO = date(1899, 12, 30)
SHEET = "xl/worksheets/sheet"


class Unreadable(ValueError):
    """Why a file isn't a workbook that can be read."""


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def column(reference: str) -> int:
    """The index from 0 of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e) == "numFmt"}
    dated = lambda n: n in DATE_FORMATS or bool(re.search("[dy]", re.sub(r'"[^"]*"|\[[^]]*\]|\\.', "", own.get(n, "")), re.I))
    return [dated(int(x.get("numFmtId", 0))) for e in root.iter() if _local(e) == "cellXfs" for x in e]


def _shown(kind: str, value: str, dated: bool) -> str:
    """A cell's value as a delimited file would have it: dates without times, neither truth values nor times of day, figures to the paisa."""
    if kind == "b" or (dated and kind == "n" and 0 <= float(value) < 1):
        return ""
    if kind == "d":
        return value[:10]
    if dated and kind == "n":
        return (DAY_ZERO + timedelta(days=int(float(value)))).isoformat()
    if kind == "n" and re.fullmatch(r"-?\d+\.\d{3,}(E-?\d+)?|-?\d+(\.\d+)?E[+-]?\d+", value):
        return f"{float(value):.2f}"  # binary fractions of a figure to the paisa
    return value


def _in_order(book: zipfile.ZipFile) -> list[str]:
    """The parts of the sheets as the workbook orders them; by number where it doesn't say."""
    parts = sorted((n for n in book.namelist() if n.startswith(SHEET)), key=lambda n: int(re.sub(r"\D", "", n) or 0))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        return parts
    targets = {e.get("Id"): "xl/" + e.get("Target", "").removeprefix("/xl/").removeprefix("xl/") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    named = [targets.get(v) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet" for k, v in e.attrib.items() if k.endswith("}id")]
    return [x for x in named if x in parts] or parts


def sheets(content: bytes) -> Iterator[list[list[str]]]:
    """Each sheet's rows, in the workbook's order; cells that aren't there are empty. Sheets are read as they are asked for, row by row."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            strings = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
            dated = _date_styles(book)
            if not (parts := _in_order(book)):
                raise Unreadable("the workbook has no sheet")
            for part in parts:
                out: list[list[str]] = []
                with book.open(part) as f:
                    for _, row in ElementTree.iterparse(f):
                        if _local(row) != "row":
                            continue
                        while len(out) < int(row.get("r", len(out) + 1)) - 1:
                            out.append([])
                        cells: list[str] = []
                        for cell in row:
                            at, kind = column(cell.get("r")) if cell.get("r") else len(cells), cell.get("t", "n")
                            cells += [""] * (at - len(cells))
                            value = next((x.text or "" for x in cell if _local(x) == "v"), "")
                            style = int(cell.get("s", 0))
                            cells.append(_text(cell) if kind == "inlineStr" else strings[int(value)] if kind == "s" and value else _shown(kind, value, style < len(dated) and dated[style]) if value else "")
                        out.append(cells)
                        row.clear()
                yield out
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, OverflowError) as e:
        raise Unreadable(f"not a workbook: {e}") from None


def grid(content: bytes) -> list[list[str]]:
    """The first sheet's rows."""
    return next(sheets(content))


def _name(k: int) -> str:
    return (_name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
SHEET_HEAD, SHEET_FOOT = f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>', "</sheetData></worksheet>"


def frame(sheets: list[str]) -> dict[str, str]:
    """The parts of a workbook around its sheets of these names."""
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/{SHEET}{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="r{k}"/>' for k, name in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>",
    }
    return {name: HEAD + text for name, text in parts.items()}


def book(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet; numbers are numbers, null is no cell, all else is text."""
    cell = lambda k, r, v: f'<c r="{_name(k)}{r}"><v>{v}</v></c>' if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else f'<c r="{_name(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(k, r, v) for k, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for path, text in (frame(["ledger"]) | {f"{SHEET}1.xml": SHEET_HEAD + body + SHEET_FOOT}).items():
            target.writestr(path, text)
    return out.getvalue()

"""Text of DOCX and XLSX containers, used inside tasks by ``sources.files``."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pandas.io.parsers import TextParser

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in spreadsheet number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def docx_text(content: bytes) -> str:
    """Non-empty paragraphs, then one ``a | b`` line per table row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    lines = [_paragraph(p).strip() for p in body.findall(f"{WORD}p")]
    for table in body.findall(f"{WORD}tbl"):
        above: list[str] = []
        for row in table.findall(f"{WORD}tr"):
            above = _row_cells(row, above)
            lines.append(" | ".join(t for t in (c.strip() for c in above) if t))
    return "\n".join(line for line in lines if line)


def _paragraph(paragraph) -> str:
    parts: list[str] = []
    for child in paragraph:
        runs = [child] if child.tag == f"{WORD}r" else child.findall(f"{WORD}r") if child.tag == f"{WORD}hyperlink" else []
        for run in runs:
            for piece in run:
                kind = piece.tag.removeprefix(WORD)
                if kind == "t":
                    parts.append(piece.text or "")
                elif kind in ("tab", "ptab"):
                    parts.append("\t")
                elif kind == "cr" or (kind == "br" and piece.get(f"{WORD}type", "textWrapping") == "textWrapping"):
                    parts.append("\n")
                elif kind == "noBreakHyphen":
                    parts.append("-")
    return "".join(parts)


def _row_cells(row, above: list[str]) -> list[str]:
    """Cell texts by grid column; spanned and vertically merged cells repeat."""
    cells: list[str] = []
    for cell in row.findall(f"{WORD}tc"):
        span, merge = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
        text = "\n".join(_paragraph(p) for p in cell.findall(f"{WORD}p"))
        if merge is not None and merge.get(f"{WORD}val", "continue") == "continue" and len(cells) < len(above):
            text = above[len(cells)]
        cells.extend([text] * (int(span.get(f"{WORD}val")) if span is not None else 1))
    return cells


def xlsx_sheets(content: bytes) -> list[tuple[str, str]]:
    """(sheet name, canonical CSV) per sheet in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).findall(f"{PACKAGE_REL}Relationship")
        }
        shared = []
        if "xl/sharedStrings.xml" in names:
            items = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in items.findall(f"{SHEET}si")]
        dates = _date_styles(archive.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        result = []
        for sheet in book.iter(f"{SHEET}sheet"):
            target = links[sheet.get(f"{REL}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            rows = _sheet_rows(archive.read(path), shared, dates)
            frame = TextParser(rows, header=0).read() if rows else pd.DataFrame()
            result.append((sheet.get("name"), frame.to_csv(index=False)))
    return result


def _date_styles(content: bytes) -> set[int]:
    styles = ElementTree.fromstring(content)
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        for f in styles.iter(f"{SHEET}numFmt")
    }
    formats = styles.find(f"{SHEET}cellXfs")
    found = set()
    for index, style in enumerate(formats if formats is not None else []):
        number = int(style.get("numFmtId", "0"))
        if number in DATE_FORMATS or re.search(r"[dmyhs]", custom.get(number, ""), re.IGNORECASE):
            found.add(index)
    return found


def _sheet_rows(content: bytes, shared: list[str], dates: set[int]) -> list[list]:
    rows: list[list] = []
    for row in ElementTree.fromstring(content).iter(f"{SHEET}row"):
        number = int(row.get("r", len(rows) + 1))
        while len(rows) < number - 1:
            rows.append([])
        values: list = []
        for cell in row.findall(f"{SHEET}c"):
            column = _column_index(cell.get("r")) if cell.get("r") else len(values)
            values.extend([""] * (column - len(values)))
            values.append(_cell_value(cell, shared, dates))
        rows.append(values)
    while rows and all(v == "" for v in rows[-1]):
        rows.pop()
    width = max((len(r) for r in rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group(0):
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell_value(cell, shared: list[str], dates: set[int]):
    kind, value = cell.get("t", "n"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "d"):
        return value.text
    if kind == "e":
        return float("nan")
    number = float(value.text)
    if int(cell.get("s", "0")) in dates:
        return datetime(1899, 12, 30) + timedelta(days=number)
    return int(number) if number.is_integer() else number

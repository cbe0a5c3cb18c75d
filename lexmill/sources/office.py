"""Word and Excel files as Markdown: each file is a zip folder of XML, read from Spark's binary file source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.rows import per_row

#: Name spaces of the two formats, and the numbers of built-in formats that stand for dates.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATES = {*range(14, 23), 45, 46, 47}


def _parsed(folder: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part of the file, or None where there is none.  Documents that declare entities are refused."""
    if name not in folder.namelist():
        return None
    data = folder.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def markdown_rows(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, a rule below the first."""
    lines = ["| " + " | ".join(cells) + " |" for cells in rows]
    if not lines:
        return ""
    rule = "| " + " | ".join(["---"] * max(lines[0].count("|") - 1, 1)) + " |"
    return "\n".join([lines[0], rule, *lines[1:]])


def _run_text(node: ElementTree.Element) -> str:
    """Text of a paragraph: its runs, also those of links, with tabs and breaks, without deleted text."""
    out: list[str] = []
    for child in node:
        kind = child.tag.removeprefix(WORD)
        if kind == "t":
            out.append(child.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
        elif kind == "noBreakHyphen":
            out.append("-")
        elif kind in ("r", "hyperlink"):
            out.append(_run_text(child))
    return "".join(out)


def _cell_text(cell: ElementTree.Element) -> str:
    return "\n".join(_run_text(p) for p in cell.findall(f"{WORD}p")).strip().replace("\n", " ")


def _table_rows(table: ElementTree.Element) -> Iterator[list[str]]:
    """Rows of cells; a cell that spans columns stands in each, and one that goes on from the row above has its text."""
    above: dict[int, str] = {}
    for row in table.findall(f"{WORD}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{WORD}tc"):
            span, merged = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
            goes_on = merged is not None and merged.get(f"{WORD}val", "continue") == "continue"
            text = above.get(len(cells), "") if goes_on else _cell_text(cell)
            for _ in range(int(span.get(f"{WORD}val", 1)) if span is not None else 1):
                above[len(cells)] = text
                cells.append(text)
        yield cells


def docx_markdown(data: bytes) -> str:
    """Paragraphs, headings and tables of a Word file in their order, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as folder:
        body = _parsed(folder, "word/document.xml")
        styles = _parsed(folder, "word/styles.xml")
    names = {}
    for style in styles.iter(f"{WORD}style") if styles is not None else ():
        name = style.find(f"{WORD}name")
        if name is not None:
            names[style.get(f"{WORD}styleId")] = name.get(f"{WORD}val", "")
    parts: list[str] = []
    top = body.find(f"{WORD}body") if body is not None else None
    for node in top if top is not None else ():
        if node.tag == f"{WORD}p":
            text = _run_text(node).strip()
            used = node.find(f"{WORD}pPr/{WORD}pStyle")
            style = names.get(used.get(f"{WORD}val"), "") if used is not None else ""
            if text and style.lower().startswith("heading"):
                level = style[len("heading") :].strip()
                text = "#" * (int(level) if level.isdigit() else 1) + " " + text
            parts.append(text)
        elif node.tag == f"{WORD}tbl":
            parts.append(markdown_rows(list(_table_rows(node))))
    return "\n\n".join(p for p in parts if p)


def _shared(folder: zipfile.ZipFile) -> list[str]:
    root = _parsed(folder, "xl/sharedStrings.xml")
    # phonetic readings stand in rPh and are no part of the text
    return ["".join(t.text or "" for part in (si, *si.findall(f"{SHEET}r")) for t in part.findall(f"{SHEET}t")) for si in root.findall(f"{SHEET}si")] if root is not None else []


def _date_styles(folder: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    root = _parsed(folder, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{SHEET}numFmt")}
    dates = DATES | {i for i, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE)}
    formats = root.find(f"{SHEET}cellXfs")
    return {i for i, xf in enumerate(formats if formats is not None else ()) if int(xf.get("numFmtId", 0)) in dates}


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]*", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out


def _number(text: str) -> str:
    value = float(text)
    return text if re.fullmatch(r"-?\d+", text) else str(int(value)) if value.is_integer() and "." not in text and "e" not in text.lower() else str(value)


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], since: datetime) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{SHEET}v")
    text = v.text or "" if v is not None else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if kind == "s":
        return shared[int(text)] if text else ""
    if kind == "b":
        return "True" if text == "1" else "False"
    if kind == "n" and text:
        if int(cell.get("s", 0)) in dates:
            days = float(text)
            # the calendar of 1900 counts a 29 February that was not
            days += since.year == 1899 and days < 60
            return str(since + timedelta(seconds=round(days * 86400)))
        return _number(text)
    return text


def xlsx_markdown(data: bytes) -> str:
    """Every sheet of a workbook under its name, its rows that are not blank as a Markdown table."""
    parts: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as folder:
        book, links = _parsed(folder, "xl/workbook.xml"), _parsed(folder, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in (links if links is not None else ())}
        shared, dates = _shared(folder), _date_styles(folder)
        about = book.find(f"{SHEET}workbookPr") if book is not None else None
        since = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in book.iter(f"{SHEET}sheet") if book is not None else ():
            parts.append(f"## {sheet.get('name')}")
            target = targets.get(sheet.get(f"{RELATION}id"), "")
            root = _parsed(folder, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            rows: list[list[str]] = []
            for row in root.iter(f"{SHEET}row") if root is not None else ():
                cells: list[str] = []
                for cell in row.findall(f"{SHEET}c"):
                    at = _column(cell.get("r", "")) or len(cells) + 1
                    cells += [""] * (at - len(cells))
                    cells[at - 1] = _value(cell, shared, dates, since)
                rows.append(cells)
            width = max(map(len, rows), default=0)
            rows = [r + [""] * (width - len(r)) for r in rows if any(c.strip() for c in r)]
            if rows:
                parts.append(markdown_rows(rows))
    return "\n\n".join(parts)


def office_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, source_type, text, error) of the .docx and .xlsx files under a path; a file that cannot be read has its error in place of a text.

    A file is one row and is read whole, as its parts lie anywhere in it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,DOCX,xlsx,XLSX}").load(path).select("path", "content")

    def make(name: str, content: bytes) -> list[tuple]:
        word = name.lower().endswith(".docx")
        try:
            return [("docx" if word else "excel", (docx_markdown if word else xlsx_markdown)(content), None)]
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError) as e:
            return [("docx" if word else "excel", None, f"{type(e).__name__}: {e}")]

    return per_row(files, ["path"], ["path", "content"], "source_type string, text string, error string", make).withColumn("doc_id", F.md5("text")).select("path", "doc_id", "source_type", "text", "error")

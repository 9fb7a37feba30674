"""Office documents by their zipped XML: sheets of workbooks, paragraphs and tables of texts and slides.

Files come as ``binaryFile`` rows, whole, and are read in the task that has them. A file that can't be opened is a row with
an error and confidence 0, never a failed task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_CELL = re.compile(r"([A-Z]+)(\d+)")


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _find(root, *names: str) -> list:
    return [e for e in root.iter() if _local(e) in names]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cells as text) of a workbook, in its order; empty sheets are left out, missing cells are ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in _find(s, "t")) for s in _find(xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        target = {_attribute(r, "Id"): r.get("Target") for r in _find(xml("xl/_rels/workbook.xml.rels"), "Relationship")}
        out = []
        for sheet in _find(xml("xl/workbook.xml"), "sheet"):
            place = target[_attribute(sheet, "id")].lstrip("/")
            rows: list[list[str]] = []
            for row in _find(xml(place if place.startswith("xl/") else f"xl/{place}"), "row"):
                cells: list[str] = []
                for c in _find(row, "c"):
                    at = _column(_CELL.match(c.get("r"))[1]) if c.get("r") else len(cells)
                    value = "".join(v.text or "" for v in _find(c, "v", "t"))
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
                if any(cells):
                    rows.append(cells)
            if rows:
                width = max(map(len, rows))
                out.append((sheet.get("name"), [r + [""] * (width - len(r)) for r in rows]))
        return out


def markdown(rows: list[list[str]]) -> str:
    """A table with its first row as the head; line feeds in cells are spaces."""
    lines = ["| " + " | ".join(c.replace("\n", " ").strip() for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join("---" for _ in rows[0]) + "|", *lines[1:]]) if rows else ""


def _text(paragraph) -> str:
    return "".join("\t" if _local(e) == "tab" else "\n" if _local(e) == "br" else e.text or "" for e in _find(paragraph, "t", "tab", "br")).strip()


def _tables(root) -> list[str]:
    return [markdown([["\n".join(filter(None, map(_text, _find(cell, "p")))) for cell in row if _local(cell) == "tc"] for row in table if _local(row) == "tr"]) for table in _find(root, "tbl")]


def document(content: bytes) -> tuple[str, list[str], int, float]:
    """(text, tables, pages, confidence) of a text document: paragraphs outside tables, by empty lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    inside = {id(p) for table in _find(root, "tbl") for p in _find(table, "p")}
    parts = [t for p in _find(root, "p") if id(p) not in inside and (t := _text(p))]
    return "\n\n".join(parts), _tables(root), 1, 1.0 if parts else 0.3


def slides(content: bytes) -> tuple[str, list[str], int, float]:
    """(text, tables, pages, confidence) of a presentation: the paragraphs of each slide below its number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
        parts, tables = [], []
        for number, name in enumerate(names, 1):
            root = ElementTree.fromstring(z.read(name))
            inside = {id(p) for table in _find(root, "tbl") for p in _find(table, "p")}
            found = [t for p in _find(root, "p") if id(p) not in inside and (t := _text(p))]
            if found:
                parts.append(f"--- Slide {number} ---\n" + "\n".join(found))
            tables += _tables(root)
    return "\n\n".join(parts), tables, len(names), 1.0 if parts else 0.5


def _book(content: bytes) -> tuple[str, list[str], int, float]:
    sheets = [(name, markdown(rows)) for name, rows in workbook(content)]
    return "\n\n".join(f"[{name}]\n{t}" for name, t in sheets), [t for _, t in sheets], len(sheets), 1.0


PARSERS = {"xlsx": _book, "xlsm": _book, "docx": document, "pptx": slides}


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """file, text, tables, n_pages, confidence, error of the office files below a path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text, tables, pages, sure = PARSERS[file.rpartition(".")[2].lower()](bytes(content))
                    error = None
                except Exception as e:  # whatever a damaged file raises
                    text, tables, pages, sure, error = "", [], 0, 0.0, type(e).__name__
                yield pd.DataFrame({"file": [file], "text": [text], "tables": [tables], "n_pages": [pages], "confidence": [sure], "error": [error]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,docx,pptx}").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, text string, tables array<string>, n_pages int, confidence double, error string")

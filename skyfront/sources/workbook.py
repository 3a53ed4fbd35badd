"""Spreadsheets (``.xlsx``): a zip of XML parts, read cell by cell.

A workbook can't be split, so each is a task; Spark reads the file, so any of its file systems
will do. Rows are parsed one after another. A sheet has at most 1,048,576 rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names that parts of a workbook are written under.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT = "http://schemas.openxmlformats.org/package/2006/content-types"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
MOST_ROWS = 1 << 20


def _tag(name: str, space: str = MAIN) -> str:
    return f"{{{space}}}{name}"


def _text(node) -> str:
    """Text of a string item; what is only there to be read aloud is left out."""
    return "".join(t.text or "" for part in ([node] if node.find(_tag("t")) is not None else node.findall(_tag("r"))) for t in part.findall(_tag("t")))


def _parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets, in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_tag("Relationship", PACKAGE))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_tag("sheet"))
    return [(s.get("name"), posixpath.normpath(posixpath.join("xl", links[s.get(_tag("id", OFFICE))])).lstrip("/").removeprefix("xl/xl/")) for s in sheets]


def column_of(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def name_of(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _value(cell, shared: Sequence[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(_tag("v"))
    if kind == "inlineStr":
        inline = cell.find(_tag("is"))
        return _text(inline) if inline is not None else None
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value.strip() == "1" else "false"
    return value


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet's rows that are there; an empty or wrong cell is None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = _parts(book)
        at = sheet if isinstance(sheet, int) else [n for n, _ in parts].index(sheet)
        shared = [_text(i) for i in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_tag("si"))] if "xl/sharedStrings.xml" in book.namelist() else []
        last = 0
        with book.open(parts[at][1]) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != _tag("row"):
                    continue
                last = int(node.get("r", last + 1))
                cells: list[str | None] = []
                for c in node.findall(_tag("c")):
                    k = column_of(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k - len(cells)) + [_value(c, shared)]
                yield last, cells
                node.clear()  # rows that were read are not kept


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet's rows, all columns as text under the names of its first row that has any; rows without
    a value are left out, short rows are filled with nulls."""
    content = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = [(n, c) for n, c in rows_of(raw.as_py(), sheet) if any(x is not None and x != "" for x in c)]
                for i in range(0, len(rows), 5000):
                    part = rows[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int32()), pa.array([c for _, c in part], pa.list_(pa.string()))], ["row", "cells"])

    rows = content.mapInArrow(run, "row int, cells array<string>")
    head = rows.orderBy("row").first()
    if head is None:
        raise ValueError(f"{path} has no rows")
    names = [(k, c.strip()) for k, c in enumerate(head.cells) if c is not None and c.strip()]
    if len({n for _, n in names}) != len(names):
        raise ValueError(f"{path} has columns of one name: {[n for _, n in names]}")
    return rows.where(F.col("row") > head.row).select(*(F.get("cells", F.lit(k)).alias(n) for k, n in names))


def workbook(names: Sequence[str], rows: Iterable[Sequence], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers and truth values as such, all else as shared text."""
    shared: dict[str, int] = {}

    def cell(k: int, n: int, value) -> str:
        at = f"{name_of(k)}{n}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for n, row in enumerate(chain([names], rows), 1):
                if n > MOST_ROWS:
                    raise ValueError(f"a sheet has {MOST_ROWS} rows at most")
                f.write(f'<row r="{n}">{"".join(cell(k, n, v) for k, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
        items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}" count="{len(shared)}" uniqueCount="{len(shared)}">{items}</sst>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "".join(f'<Override PartName="/{part}" ContentType="{KIND}.{kind}+xml"/>' for part, kind in (("xl/workbook.xml", "sheet.main"), ("xl/worksheets/sheet1.xml", "worksheet"), ("xl/sharedStrings.xml", "sharedStrings")))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{CONTENT}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
    return out.getvalue()


def write_workbook(df: DataFrame, path: str) -> None:
    """A table as one sheet, made by one task, as a sheet has no parts, and put at ``path`` by Spark's
    own file system. A sheet's rows are bounded (MOST_ROWS)."""
    names = df.columns

    def run(batches):
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([workbook(names, rows)], pa.binary())], ["content"])

    made = df.coalesce(1).mapInArrow(run, "content binary").first()
    content = workbook(names, []) if made is None else bytes(made.content)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(content)
    finally:
        out.close()

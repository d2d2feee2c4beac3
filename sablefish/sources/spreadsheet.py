"""Spreadsheets (zipped sheet XML) as rows of text.

Files are read with Spark's binaryFile reader, so any store Spark reaches works, a file a task; a sheet's XML is parsed as a stream and its rows leave in
batches, so a task holds the file and its shared strings but never the sheet as a tree.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = "PK\x03\x04"
BATCH_ROWS = 2000


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    """All text below an element but phonetic readings."""
    return "".join(t.text or "" for t in element.iter() if _name(t.tag) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e.tag) == "si":
                out.append(_text(e))
                e.clear()
    return out


def column_of(reference: str) -> int:
    """The place (from 0) that the letters of a cell's reference name."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = [n for n in book.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")]
    return min(sheets, key=lambda n: (len(n), n))


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    value = next((e.text or "" for e in cell if _name(e.tag) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "n" and value:
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else value
    return value


def sheet_rows(raw: bytes) -> Iterator[list[str]]:
    """The rows of the first sheet, cells by their column, missing ones empty; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = _shared(book)
        with book.open(_first_sheet(book)) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) != "row":
                    continue
                row: list[str] = []
                for k, cell in enumerate(c for c in e if _name(c.tag) == "c"):
                    at = column_of(cell.get("r", "")) if cell.get("r") else k
                    row.extend([""] * (at + 1 - len(row)))
                    row[at] = _cell(cell, shared)
                e.clear()
                if row:
                    yield row


def parsed(files: DataFrame) -> DataFrame:
    """path, row (from 0) and cells of the first sheet of each file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                some: list[list[str]] = []
                first = 0
                for row in sheet_rows(raw):
                    some.append(row)
                    if len(some) == BATCH_ROWS:
                        yield _batch(name, first, some)
                        first, some = first + len(some), []
                yield _batch(name, first, some)

    return files.select("path", "content").mapInArrow(run, "path string, row long, cells array<string>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0) and cells of the first sheet of each file of a path."""
    return parsed(spark.read.format("binaryFile").load(path))


def _batch(name: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["path", "row", "cells"])


def table(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a file with the names of its first row as columns, all text, and ``_row`` for its order."""
    rows = read(spark, path)
    first = rows.where("row = 0").select("cells").collect()
    names = [n.strip() or f"_c{k}" for k, n in enumerate(first[0]["cells"])] if first else []
    return rows.where("row > 0").select(F.col("row").alias("_row"), *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])

"""Rows of workbooks and pseudo pages of text documents, read inside tasks from whole files with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LINES = 12


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet as strings, each in the column that its reference names; gaps are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root if _local(si.tag) == "si"]
        sheets = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"(\d+)\.xml", x)[1]))
        root = ElementTree.fromstring(z.read(sheets[0])) if sheets else ElementTree.Element("none")
    rows = []
    for r in (x for x in root.iter() if _local(x.tag) == "row"):
        cells: dict[int, str] = {}
        for c in (x for x in r if _local(x.tag) == "c"):
            letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1 if letters else len(cells)
            text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells): the rows below the heading of each .xlsx file, as a map from heading to cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"]):
                head, *rows = sheet_rows(content) or [[]]
                out += [(p, k, dict(zip(head, r))) for k, r in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, row long, cells map<string,string>")


def paragraphs(content: bytes) -> list[str]:
    """Texts of a .docx document's paragraphs that aren't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip() for p in root.iter() if _local(p.tag) == "p")
    return [x for x in found if x]


def pseudo_pages(lines: DataFrame, key: str, order: str, size: int = PAGE_LINES) -> DataFrame:
    """Lines that aren't empty joined to pages of ``size`` lines: key, page (from 1), text."""
    from pyspark.sql import Window

    d = lines.filter(F.length(F.trim("line")) > 0).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    d = d.withColumn("page", F.floor((F.col("_n") - 1) / size) + 1)
    rows = F.array_sort(F.collect_list(F.struct(order, "line")))
    return d.groupBy(key, "page").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, line): paragraphs of each .docx file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, x) for p, content in zip(b["path"], b["content"]) for k, x in enumerate(paragraphs(content))]
            yield pd.DataFrame(rows, columns=["path", "k", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, k long, line string")

"""Readers of the formats that documents and their parse results come in.

Binary files go through Spark's binaryFile source, one task per group of files; what cannot be read
becomes a row with an issue, not a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
BLOCKS = "path string, block_no int, text string, issue string"
CELLS = "path string, sheet string, row_no int, cell string, text string, issue string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited objects, gzip or plain; blank lines are skipped, a line that is no object fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no object: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def parse_results(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of nested parse results: doc_id, run_id, page, block_id, block_type, text, bbox."""
    block = "array<struct<block_id:string,type:string,text:string,bbox:array<double>>>"
    schema = f"doc_id string, run_id string, pages array<struct<page:int,status:string,blocks:{block}>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    p = r.select("doc_id", "run_id", F.explode("pages").alias("p")).where("p.status is null or p.status <> 'fail'")
    return p.select("doc_id", "run_id", "p.page", F.explode("p.blocks").alias("b")).select("doc_id", "run_id", "page", "b.block_id", F.col("b.type").alias("block_type"), "b.text", "b.bbox")


def _docx(data: bytes) -> Iterator[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        t = "".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter())
        if t.strip():
            yield t


def word_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """path, block_no, text, issue: non-blank paragraphs of word files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(_docx(bytes(data)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "block_no", "text", "issue"]).astype({"block_no": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, BLOCKS)


def _xlsx(data: bytes) -> Iterator[tuple[str, int, str, str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        for c in ElementTree.fromstring(z.read(name)).iter(f"{_S}c"):
            v, ref = c.find(f"{_S}v"), c.get("r", "")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
            if text is not None and c.get("t") == "s":
                text = shared[int(text)]
            if text is not None:
                yield name.rsplit("/", 1)[-1][:-4], int(re.sub(r"\D", "", ref) or 0), ref, text


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_no, cell, text, issue: filled cells of workbooks with their places."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *c, None) for c in _xlsx(bytes(data))]
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cell", "text", "issue"]).astype({"row_no": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CELLS)


def html_cells(html: Column) -> Column:
    """array<array<string>> of the cells of the rows of HTML tables, tags taken out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))))

"""Binary documents: sniffing, text of PDF and DOCX files, links, directory index. Parsers that are absent are reported, not guessed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCANNED_CHARS, KEPT_CHARS, LINKS = 200, 20_000, 8
SCHEMA = "path string, kind string, text string, pages int, scanned boolean, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def kind_of(content: Column) -> Column:
    """pdf, docx or unknown, by the first four bytes."""
    magic = F.substring(content, 1, 4)
    return F.when(magic == F.lit(b"%PDF"), "pdf").when(magic == F.lit(b"PK\x03\x04"), "docx").otherwise("unknown")


def docx_text(raw: bytes) -> str:
    """Paragraphs, with table cells joined by tabs, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = []
    for node in body:
        if node.tag == f"{_W}tbl":
            lines += ["\t".join(said(c) for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
        elif node.tag == f"{_W}p":
            lines.append(said(node))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(raw: bytes) -> tuple[str, int]:
    """Text of all pages, and their number, through pypdf, where it is installed."""
    import pypdf

    pages = pypdf.PdfReader(io.BytesIO(raw)).pages
    return "\n".join(p.extract_text() or "" for p in pages), len(pages)


def extract_text(files: DataFrame, keep_chars: int | None = None) -> DataFrame:
    """(path, kind, text, pages, scanned, error) of binary files (path, content). A PDF with fewer than SCANNED_CHARS a page
    counts as scanned. Citations and marks are read from the whole text; keep_chars cuts it for display only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, kind, raw in zip(pdf["path"], pdf["kind"], pdf["content"]):
                text, pages, scanned, error = None, None, None, None
                try:
                    if kind == "docx":
                        text, pages, scanned = docx_text(bytes(raw)), 1, False
                    elif kind == "pdf":
                        text, pages = pdf_text(bytes(raw))
                        scanned = len(text) < SCANNED_CHARS * max(pages, 1)
                    else:
                        error = "unsupported file type"
                except ImportError as x:
                    error = f"parser not installed: {x.name}"
                except Exception as x:  # a broken file is a result, not a failure of the job
                    error = f"{type(x).__name__}: {x}"[:200]
                rows.append((path, kind, text[:keep_chars] if text and keep_chars else text, pages, scanned, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "pages", "scanned", "error"])

    return files.select("path", kind_of(F.col("content")).alias("kind"), "content").mapInPandas(run, SCHEMA)


def attachment_links(content: Column, hosts: list[str]) -> Column:
    """Up to LINKS distinct URLs of allowed hosts in a PDF's uncompressed link annotations."""
    text = F.decode(content, "ISO-8859-1")
    urls = F.regexp_extract_all(text, F.lit(r"/URI\s*\((https?://[^)\s]+)\)"), F.lit(1))
    allowed = "|".join(re.escape(h) for h in hosts)
    return F.slice(F.array_distinct(F.filter(urls, lambda u: u.rlike(rf"^https?://([^/]+\.)?({allowed})(/|$)"))), 1, LINKS)


def file_index(files: DataFrame, pattern: str = r"(\d{4,})") -> DataFrame:
    """(id, paths) from one listing, the id being the pattern's group in the file name."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract(name, pattern, 1).alias("id"), "path").where("id <> ''").groupBy("id").agg(F.array_sort(F.collect_list("path")).alias("paths"))

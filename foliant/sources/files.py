"""Readers of text, HTML, Word and PDF files."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.html import page_text, title
from foliant.functions.text import Normalization, normalized, strip

logger = logging.getLogger("foliant.sources")
# Extensions by reader; a later reader wins.
EXTENSIONS = {
    "text": (".txt", ".text", ".md", ".markdown"),
    "html": (".html", ".htm"),
    "pdf": (".pdf",),
    "docx": (".docx",),
}
#: Characters that make a PDF page a text page, and the share of text pages under which recognition is tried.
PAGE_CHARS, TEXT_RATIO = 50, 0.3


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)\z", 1))


def reader_for(path: Column) -> Column:
    """The name of the reader of a path, or null."""
    found = F.lit(None).cast("string")
    for name, extensions in EXTENSIONS.items():
        found = F.when(extension(path).isin(*extensions), F.lit(name)).otherwise(found)
    return found


def formats(spark: SparkSession) -> DataFrame:
    """(extension, reader) of everything that can be read."""
    return spark.createDataFrame([(e, name) for name, extensions in EXTENSIONS.items() for e in extensions], "extension string, reader string")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 for bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def text_documents(files: DataFrame, how: Normalization | None = None) -> DataFrame:
    """Files with text, char_count and line_count; ``how`` None takes the readers' normalization."""
    raw = files.withColumn("_raw", decoded(F.col("content")))
    made = raw.withColumn("text", normalized("_raw", how or Normalization.for_files()))
    return made.select("path", F.lit("text").alias("file_type"), "text", F.length("text").alias("char_count"), F.size(F.split("text", "\n")).alias("line_count"), F.length("_raw").alias("original_char_count"))


def html_documents(pages: DataFrame, content: str = "html", how: Normalization | None = None) -> DataFrame:
    """Pages with title, text and char_count."""
    made = pages.withColumns({"title": title(content), "text": page_text(content, how)})
    return made.withColumn("char_count", F.length("text"))


# -- Word ---------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOCX = "path string, paragraphs array<string>, table_rows array<array<string>>, headers array<string>, footers array<string>, title string, author string, error string"


def _texts(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab",):
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _paragraphs(node: ElementTree.Element) -> list[str]:
    return [t for p in node.findall(f"{_W}p") if (t := _texts(p).strip())]


def docx_parts(content: bytes) -> dict:
    """Paragraphs, table cells, headers, footers and properties of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        rows = [[c for cell in row.findall(f"{_W}tc") if (c := "\n".join(_texts(p) for p in cell.findall(f"{_W}p")).strip())] for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
        sides: dict[str, list[str]] = {"header": [], "footer": []}
        for name in sorted(z.namelist()):
            for side in sides:
                if name.startswith(f"word/{side}") and name.endswith(".xml"):
                    sides[side] += _paragraphs(ElementTree.fromstring(z.read(name)))
        properties: dict[str, str | None] = {}
        if "docProps/core.xml" in z.namelist():
            for x in ElementTree.fromstring(z.read("docProps/core.xml")):
                properties[x.tag.rpartition("}")[2]] = x.text
    return {"paragraphs": _paragraphs(body), "table_rows": [r for r in rows if r], "headers": sides["header"], "footers": sides["footer"], "title": properties.get("title"), "author": properties.get("creator")}


def docx_documents(files: DataFrame, tables: bool = True, headers: bool = False, how: Normalization | None = None) -> DataFrame:
    """Word files (path, content) with text and properties; a broken file has an error and no text.

    Python only unpacks and parses the container; the text is assembled by expressions: a block of headers and footers
    if asked for, paragraphs, and the rows of tables with cells between tabs.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append({"path": path, "error": None} | docx_parts(content))
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, AttributeError) as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _DOCX.split(", ")]).astype(object).where(lambda x: x.notna(), None)

    parts = files.select("path", "content").mapInPandas(parse, _DOCX)
    none = F.array().cast("array<string>")
    listed = lambda c, label: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(f"[{label}] "), x))
    sides = F.concat(listed(F.col("headers"), "Header"), listed(F.col("footers"), "Footer"))
    block = F.when(F.size(sides) > 0, F.concat(F.array(F.lit("--- Headers/Footers ---")), sides, F.array(F.lit("")))).otherwise(none) if headers else none
    cells = F.transform(F.col("table_rows"), lambda r: F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), "\t"))
    rows = F.when(F.size("table_rows") > 0, F.concat(F.array(F.lit(""), F.lit("--- Tables ---")), cells)).otherwise(none) if tables else none
    whole = F.array_join(F.concat(block, F.coalesce("paragraphs", none), rows), "\n")
    text = F.when(F.col("error").isNull(), normalized(whole, how or Normalization.for_files()))
    return parts.select("path", F.lit("docx").alias("file_type"), text.alias("text"), F.size("paragraphs").alias("paragraph_count"), "title", "author", "error")


# -- PDF ----------------------------------------------------------------------------------------------


def pdf_text(pages: Column, how: Normalization | None = None) -> Column:
    """Page texts (null: extraction failed) as one text, each page under its number."""
    how = how or Normalization.for_files()

    def page(p: Column, i: Column) -> Column:
        body = F.when(p.isNull(), F.lit("[Extraction failed]")).when(F.length(strip(p)) >= PAGE_CHARS, normalized(p, how)).otherwise(F.lit("[No text content]"))
        return F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), body)

    return F.array_join(F.transform(pages, page), "\n\n")


def text_ratio(pages: Column) -> Column:
    """The share of pages that are text pages; 0 without pages."""
    n = F.size(F.filter(pages, lambda p: F.coalesce(F.length(strip(p)) >= PAGE_CHARS, F.lit(False))))
    return F.coalesce(F.try_divide(n.cast("double"), F.size(pages)), F.lit(0.0))


def needs_recognition(pages: Column, enabled: bool) -> Column:
    return F.lit(enabled) & (text_ratio(pages) < TEXT_RATIO)


def is_scanned(pages: Column) -> Column:
    """Whether the first three pages have fewer than 50 characters on average."""
    first = F.slice(pages, 1, 3)
    total = F.aggregate(first, F.lit(0), lambda a, p: a + F.coalesce(F.length(strip(p)), F.lit(0)))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(first)) < PAGE_CHARS, F.lit(False))


PageParser = Callable[[bytes], list[str]]


def _needs_recognition(pages: list[str | None]) -> bool:
    return sum(len((p or "").strip()) >= PAGE_CHARS for p in pages) < TEXT_RATIO * len(pages) or not pages


def pdf_documents(files: DataFrame, parser: PageParser, how: Normalization | None = None, recognizer: PageParser | None = None) -> DataFrame:
    """PDF files (path, content) through a parser of bytes to page texts, as text and page figures.

    Where fewer pages than ``TEXT_RATIO`` are text pages, ``recognizer`` is asked for the pages instead, if there is one;
    its texts are normalized as scans are. A recognizer that fails leaves the pages of the parser.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found, scanned = parser(content), False
                    if recognizer is not None and _needs_recognition(found):
                        try:
                            found, scanned = recognizer(content), True
                        except Exception as e:  # what the parser found is kept
                            logger.warning("recognition of %s failed: %s", path, e)
                    rows.append((path, found, scanned, None))
                except Exception as e:  # a broken file is a row with an error
                    rows.append((path, None, False, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pages", "recognized", "error"])

    pages = files.select("path", "content").mapInPandas(parse, "path string, pages array<string>, recognized boolean, error string")
    text = F.when(F.col("recognized"), pdf_text(F.col("pages"), how or Normalization.for_files(scanned=True))).otherwise(pdf_text(F.col("pages"), how))
    text = F.when(F.col("error").isNull(), text)
    return pages.select("path", F.lit("pdf").alias("file_type"), text.alias("text"), "recognized", F.size("pages").alias("page_count"), F.bround(text_ratio(F.col("pages")), 2).alias("text_extraction_ratio"), is_scanned(F.col("pages")).alias("scanned"), "error")

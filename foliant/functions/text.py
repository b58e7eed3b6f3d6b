"""Text normalization and scalar text functions as Columns.

Lengths and offsets are Unicode code points. White space is Unicode's, with the four ASCII separators, and a
line ends at a line feed only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that results depend on.
SPACE = r"[\s\x1c-\x1f]"
#: The characters that SPACE means under (?U), one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
CONTROL = r"[\p{C}&&[^\n\r\t]]"
PAGE_MARKER = r"(?imdU)^\s*\[?(?:Page|PAGE|p\.?)\s*\d+\s*\]?\s*$"
PAGE_NUMBER = r"(?mdU)^\s*\d{1,4}\s*$"
HEADERS = (
    r"(?imdU)^\s*(?:CONFIDENTIAL|DRAFT|INTERNAL)\s*$",
    r"(?imdU)^\s*(?:Copyright|©)\s*\d{4}.*$",
    r"(?imdU)^\s*\d+\s*of\s*\d+\s*$",
)
#: Characters that optical recognition confuses, what they become, and those that are dropped.
OCR_FROM, OCR_TO, OCR_DROPPED = "|0l—–", "IO1--", "­​﻿"


def text_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(text_column(text), F.lit(SPACES))


def tokens(text: Column | str) -> Column:
    """The runs of characters between white space, in order."""
    return F.filter(F.split(text_column(text), rf"(?U){SPACE}+", -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


@dataclass(frozen=True)
class Normalization:
    """Which steps ``normalized`` takes."""

    control: bool = True
    whitespace: bool = True
    newlines: bool = True
    page_markers: bool = True
    repeated_lines: bool = False
    ocr: bool = False
    paragraphs: bool = True
    strip_lines: bool = True
    min_line: int = 3

    @classmethod
    def for_files(cls, scanned: bool = False) -> Normalization:
        """What file readers use: page markers stay, and scans get header detection and character repair."""
        return cls(page_markers=False, repeated_lines=scanned, ocr=scanned)


def without_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def repaired_ocr(text: Column) -> Column:
    swapped = F.translate(text, OCR_FROM + OCR_DROPPED, OCR_TO)
    return F.replace(swapped, F.lit("…"), F.lit("..."))


def stripped_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n")


def without_page_markers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, PAGE_MARKER, ""), PAGE_NUMBER, "")


def without_repeated_lines(text: Column, min_line: int = 3, times: int = 3, below: int = 50) -> Column:
    """Drops header lines of fixed shapes, and short lines that stand in the text ``times`` times or more.

    Among the sorted lines one repeats often enough if it equals the one ``times - 1`` places on; that
    takes one sort a text, whatever its number of lines.
    """
    for pattern in HEADERS:
        text = F.regexp_replace(text, pattern, "")
    lines = F.split(text, "\n", -1)
    short = F.array_sort(F.filter(F.transform(lines, strip), lambda x: (F.length(x) >= min_line) & (F.length(x) < below)))
    again = let(short, lambda s: F.filter(F.transform(s, lambda x, i: F.when(F.get(s, i + times - 1) == x, x)), lambda x: x.isNotNull()))
    return let(F.array_distinct(again), lambda repeated: F.array_join(F.filter(lines, lambda x: ~F.array_contains(repeated, strip(x))), "\n"))


def single_spaced(text: Column) -> Column:
    return stripped_lines(F.regexp_replace(text, r"[ \t]+", " "))


def bounded_newlines(text: Column, paragraphs: bool = True) -> Column:
    if not paragraphs:
        return F.replace(text, F.lit("\n"), F.lit(" "))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?mdU)^\s+$", "")


def normalized(text: Column | str, how: Normalization = Normalization()) -> Column:
    """The text after the steps of ``how``, in their fixed order; a null or empty text gives the empty text."""
    text = F.coalesce(text_column(text), F.lit(""))
    if how.control:
        text = without_control(text)
    if how.ocr:
        text = repaired_ocr(text)
    if how.strip_lines:
        text = stripped_lines(text)
    if how.page_markers:
        text = without_page_markers(text)
    if how.repeated_lines:
        text = without_repeated_lines(text, how.min_line)
    if how.whitespace:
        text = single_spaced(text)
    if how.newlines:
        text = bounded_newlines(text, how.paragraphs)
    return strip(text)


def paragraph_starts(text: Column | str) -> Column:
    """Offsets at which paragraphs begin: 0 and the end of each run of two or more line feeds."""
    text = F.coalesce(text_column(text), F.lit(""))
    parts, gaps = F.split(text, r"\n{2,}", -1), F.regexp_extract_all(text, F.lit(r"(\n{2,})"), 1)
    lengths = F.zip_with(F.slice(parts, 1, F.size(gaps)), gaps, lambda p, g: F.length(p) + F.length(g))
    return F.aggregate(lengths, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

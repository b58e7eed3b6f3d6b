"""Titles and texts of HTML pages as Columns: a stack of open elements over the parts of a page, and regular expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import Normalization, let, normalized, strip, text_column

# Elements whose content is dropped, those without content, and those that begin a block.
DROPPED = ("script", "style", "head", "noscript")
VOID = ("meta", "link")
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "article", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "br", "hr")
#: Of the dropped ones, those whose content is no markup: only their own end tag ends them.
RAW = ("script", "style")


def unescaped(text: Column) -> Column:
    """Numeric entities, and the named ones of HTML 4, as characters; others stay. Nothing is decoded twice."""
    names = F.create_map(*(F.lit(x) for name, point in name2codepoint.items() for x in (f"&{name};", chr(point))))
    pieces = F.split(text, r"(?=&#?[A-Za-z0-9]{1,31};)|(?<=;)", -1)
    number = lambda p: F.coalesce(F.regexp_extract(p, r"\A&#([0-9]{1,5});\z", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(p, r"\A&#[xX]([0-9a-fA-F]{1,4});\z", 1), F.lit("")), 16, 10).try_cast("int"))
    plain = lambda n: (n > 0) & (n < 0xFFFE) & ((n < 0xD800) | (n > 0xDFFF))
    as_char = lambda n: F.when(plain(n), F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE"))
    decode = lambda p: F.when(F.startswith(p, F.lit("&")), F.coalesce(F.try_element_at(names, p), as_char(number(p)), p)).otherwise(p)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def title(page: Column | str) -> Column:
    """The stripped and unescaped content of the first title element, or null."""
    found = F.regexp_extract(text_column(page), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(unescaped(strip(found)), F.lit(""))


def outside_dropped(text: Column) -> Column:
    """What stands outside of dropped elements, comments too being dropped.

    Comments and raw elements go in one pass, from whichever begins first to its end or to the end of the page. The rest is parted before
    each tag of the other dropped elements, and a stack of those that are open is carried from part to part: a start tag opens one,
    an end tag closes the last open one of its name with all that was opened in it, and is nothing if there is none; a tag that closes
    itself opens nothing. An element that is not closed drops the rest of the page.
    """
    names = [n for n in DROPPED if n not in RAW]
    plain = F.regexp_replace(text, rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)", " ")
    tag = rf"</?(?:{'|'.join(names)})(?=[\s/>])[^>]*>"
    letters = {n: chr(ord("a") + i) for i, n in enumerate(names)}  # the stack is a string of these
    mark = lambda part: F.lower(F.regexp_extract(part, rf"(?is)\A</?({'|'.join(names)})(?=[\s/>])", 1))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, part: Column) -> Column:
        stack, letter = state["open"], F.coalesce(*(F.when(mark(part) == n, F.lit(x)) for n, x in letters.items()))
        last = F.length(stack) - F.instr(F.reverse(stack), letter)  # letters before the last open one of this name
        closed = F.when(F.contains(stack, letter), F.substring(stack, F.lit(1), last)).otherwise(stack)
        now = (
            F.when(letter.isNull(), stack)
            .when(F.startswith(part, F.lit("</")), closed)
            .when(F.regexp_like(part, F.lit(r"(?s)\A<[^>]*/>")), stack)
            .otherwise(F.concat(stack, letter))
        )
        return let(now, lambda open_now: F.struct(open_now.alias("open"), F.when(open_now == "", F.concat(state["kept"], F.array(part))).otherwise(state["kept"]).alias("kept")))

    parted = F.aggregate(F.split(plain, rf"(?is)(?={tag})", -1), start, step, lambda state: F.array_join(state["kept"], ""))
    return F.when(F.regexp_like(plain, F.lit(rf"(?is){tag}")), parted).otherwise(plain)


def page_text(page: Column | str, how: Normalization | None = None) -> Column:
    """The text of a page: comments and dropped elements go, block tags become blank lines, other tags and line ends spaces."""
    text = outside_dropped(F.coalesce(text_column(page), F.lit("")))
    text = F.regexp_replace(text, r"(?is)<![a-z][^>]*>", "")
    text = F.regexp_replace(text, rf"(?is)</?(?:{'|'.join(VOID)})\b[^>]*>", "")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    text = F.regexp_replace(text, rf"(?is)\s*</?(?:{'|'.join(BLOCKS)})\b[^>]*>\s*", "\n\n")
    text = F.regexp_replace(text, r"(?is)<[a-z/][^>]*>", " ")
    return normalized(unescaped(text), how or Normalization.for_files())

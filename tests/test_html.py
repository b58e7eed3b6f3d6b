"""Texts of pages against a parser of the standard library that keeps a stack of open elements."""

import html.parser
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import html as pages
from foliant.functions.text import Normalization, normalized

BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "article", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "br", "hr"}


class Specification(html.parser.HTMLParser):
    """Texts outside of dropped elements, with a space where markup parts them; void elements have no content, and an end tag closes what was opened inside its element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "noscript"):
            self.open.append(tag)
        self.out.append("\n\n" if tag in BLOCKS and not self.open else "" if tag in ("meta", "link") else " ")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n\n" if tag in BLOCKS and not self.open else " ")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.out.append("\n\n" if tag in BLOCKS and not self.open else " ")

    def handle_data(self, data):
        if not self.open:
            self.out.append(re.sub("[ \t\r\n]+", " ", data))

    @classmethod
    def text(cls, page):
        made = cls()
        made.feed(page)
        made.close()
        return re.sub(r"\s*\n\n\s*", "\n\n", "".join(made.out))


def same(spark, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, page string")
    wanted = spark.createDataFrame([(i, Specification.text(c)) for i, c in enumerate(cases)], "i int, raw string")
    made = rows.join(wanted, "i").select("i", "page", pages.page_text("page").alias("got"), normalized("raw", Normalization.for_files()).alias("want"))
    tidy = lambda x: re.sub(r"[ ]+", " ", re.sub(r" *\n\n+ *", "\n\n", x)).strip()
    wrong = [(r["page"], r["got"], r["want"]) for r in made.collect() if tidy(r["got"]) != tidy(r["want"])]
    assert wrong == []


def test_dropped_elements(spark):
    same(
        spark,
        [
            "<html><head><title>t</title><meta charset=x><link rel=y></head><body><p>one</p>two</body></html>",
            "a<noscript>b<noscript>c</noscript>d</noscript>e",
            "a<noscript>b<p>c</noscript>d",
            "a<head>b<noscript>c</head>d",
            "a</noscript>b</head>c",
            "a<noscript>never closed <p>b",
            "a<script>if (x < y) { '</p>' }</script>b<style>p > a {}</style>c",
            "a<script>never closed",
            "a<script><!-- </script> b --> c",
            "a<!-- <noscript> -->b<!-- c -->",
            "<HEAD>x</Head ><NoScript\nclass=a>y</NOSCRIPT>z",
            "<header>kept</header><headline>kept too</headline>",
            "a<noscript/>b<br/>c<br>d<hr>e",
            "a<noscript>b</noscript>c<noscript>d</noscript>e",
            "",
            "no markup at all",
        ],
    )


def test_random_nests_of_elements(spark):
    rng = random.Random(7)
    tags = ["<head>", "</head>", "<noscript>", "</noscript>", "<p>", "</p>", "<b>", "</b>", "<br>", "<meta name=a>", "<!-- c <head> -->", "<script>s</script>", "<style>t<p></style>"]
    same(spark, ["".join(rng.choice(tags) if rng.random() < 0.6 else f"w{rng.randint(0, 99)} " for _ in range(rng.randint(1, 25))) for _ in range(400)])


def test_pages_of_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").where("html is not null").collect()
    same(spark, [r["html"] for r in rows])


def test_time_follows_the_length(spark):
    def took(n):
        page = "".join(f"<noscript>x{i}</noscript><p>some text {i}</p>" for i in range(n))
        frame = spark.createDataFrame([(page,)], "page string").select(pages.page_text("page").alias("t"))
        begin = time.perf_counter()
        assert frame.first()["t"].count("some text") == n
        return time.perf_counter() - begin

    took(200)
    few = min(took(1000) for _ in range(2))
    assert min(took(2000) for _ in range(2)) < 3 * max(few, 0.3)


@pytest.mark.parametrize("page", [None, "<", "<>", "</", "<noscript", "a < b > c"])
def test_broken_pages_do_not_fail(spark, page):
    frame = spark.createDataFrame([(page,)], "page string").select(pages.page_text(F.col("page")).alias("t"))
    assert isinstance(frame.first()["t"], str)

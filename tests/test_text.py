"""Goldens and random comparisons of the text functions with plain Python specifications."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import html, sentences, terms, text


def values(spark, rows, column):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def one(spark, row, column):
    return values(spark, [row], column)[0]


def test_strip_and_tokens_use_unicode_space(spark):
    rows = ["  a b \n", "\x1fx\x85", "", None, " \t "]
    assert values(spark, rows, text.strip("t")) == ["a b", "x", "", None, ""]
    assert one(spark, " a\x85b   c", text.tokens("t")) == ["a", "b", "c"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("  Multiple   spaces   and\t\ttabs  ", "Multiple spaces and tabs"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a​b﻿­c\x00", "abc"),
        ("x\n[Page 3]\ny\np. 4\n 12 \nz", "x\n\ny\n\n\nz"),
        (None, ""),
        ("", ""),
    ],
)
def test_normalized(spark, given, expected):
    got = one(spark, given, text.normalized("t"))
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", expected)


def test_paragraphs_can_be_dropped(spark):
    assert one(spark, "a\nb\n\nc", text.normalized("t", text.Normalization(paragraphs=False))) == "a b  c"


def test_repeated_lines(spark):
    body = "Header line\none\nHeader line\ntwo\nHeader line\nthree\nDRAFT\n2 of 9"
    assert one(spark, body, text.without_repeated_lines(F.col("t"))).split("\n") == ["one", "two", "three", ""]  # white space before a header goes with it
    long = "x" * 50
    assert one(spark, "\n".join([long] * 4), text.without_repeated_lines(F.col("t"))) == "\n".join([long] * 4)


def test_ocr_repair(spark):
    assert one(spark, "|0l—–…­'", text.repaired_ocr(F.col("t"))) == "IO1--...'"


def test_paragraph_starts(spark):
    assert one(spark, "ab\n\ncd\n\n\nef\ng", text.paragraph_starts("t")) == [0, 4, 9]
    assert one(spark, "", text.paragraph_starts("t")) == [0]


def test_sentences(spark):
    assert one(spark, "Hello! How are you? I'm fine.", sentences.sentences("t")) == ["Hello!", "How are you?", "I'm fine."]
    assert one(spark, "Dr. Smith met J. Doe at no. 5. Then (ok.) he left", sentences.sentences("t")) == ["Dr. Smith met J. Doe at no. 5. Then (ok.)", "he left"]  # "5." looks like an initial
    assert one(spark, "1. 2 apples. End.", sentences.sentences("t")) == ["1. 2 apples.", "End."]
    assert values(spark, [None, " ", ""], sentences.sentences("t")) == [[], [], []]


def test_three_sentence_rules_differ(spark):
    row = "He said e.g. this. Next one! and more? Yes."
    assert one(spark, row, sentences.pattern_sentences("t")) == ["He said e.g. this.", "Next one! and more?", "Yes."]
    assert one(spark, row, sentences.sentences("t")) == ["He said e.g. this.", "Next one!", "and more?", "Yes."]
    assert one(spark, row, sentences.sentence_count("t")) == 6


def test_reading_complexity(spark):
    got = one(spark, "Elephants remember everything. So do we.", sentences.reading_complexity("t"))
    assert (got["avg_word_length"], got["avg_sentence_length"], got["long_word_ratio"]) == (5.5, 3.0, 0.5)
    assert one(spark, " ", sentences.reading_complexity("t"))["complexity_score"] == 0


def test_key_terms_against_python(spark):
    random.seed(5)
    bits = ["café", "foo_bar", "x9", "Data", "the", "ab", "naïve", "WORLD", " ", ", ", "_", "-", "\n", "ß", "hello"]
    rows = ["".join(random.choice(bits) for _ in range(12)) for _ in range(200)]
    expected = []
    for r in rows:
        words = re.findall(r"\b[a-zA-Z0-9]+\b", r.lower())
        expected.append(sorted({w for w in words if w not in terms.STOP_WORDS and len(w) >= 4}))
    assert values(spark, rows, F.array_sort(terms.key_terms("t"))) == expected


def test_ngrams_and_length(spark):
    assert one(spark, "a b c b c", terms.ngrams("t")) == ["a b", "b c", "c b"]
    assert one(spark, "word", terms.ngrams("t")) == []
    assert tuple(one(spark, " One two. Three! ", terms.text_length("t"))) == (15, 3, 2)


def test_html(spark):
    page = "<html><head><meta charset=x><title> A &amp; B </title><style>p{}</style></head><body><script>var t='</p>';</script><!-- no --><p>One <b>two</b></p><div>x&nbsp;&lt;y&#233;&#x41;</div><noscript><img>hidden</noscript></body></html>"
    assert one(spark, page, html.title("t")) == "A & B"
    assert one(spark, page, html.page_text("t")) == "One two\n\nx <yéA"
    assert one(spark, "&amp;lt; &unknown; &#99999999;", html.unescaped(F.col("t"))) == "&lt; &unknown; &#99999999;"
    assert one(spark, "<p>no title</p>", html.title("t")) is None

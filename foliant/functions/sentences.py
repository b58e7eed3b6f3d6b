"""Three ways to find sentences, which give different results and are kept apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, let, strip, text_column, tokens

# Words whose full stop does not end a sentence, by rule.
TOKEN_ABBREVIATIONS = (
    "dr mr mrs ms prof sr jr vs etc inc ltd co corp st ave blvd rd "
    "jan feb mar apr jun jul aug sep oct nov dec mon tue wed thu fri sat sun "
    "no nos vol vols pp pg pgs approx est dept div govt i.e e.g cf viz al et"
).split()
LITERAL_ABBREVIATIONS = (
    "Mr. Mrs. Ms. Dr. Prof. Inc. Ltd. Corp. Co. Jr. Sr. vs. etc. e.g. i.e. U.S. U.K. U.N. a.m. p.m. "
    "Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Oct. Nov. Dec."
).split()
#: Stands between sentences while they are joined; control characters do not occur in normalized text.
_MARK = "\u001e"
#: The characters that a token which ends a sentence can end with.
_LAST = (".", "!", "?", "。", "！", "？", ")", '"', "'")


def _ends(word: Column, after: Column) -> Column:
    """Whether a token ends a sentence, given the token after it."""
    bare = F.lower(F.regexp_replace(word, r"[.)!?]+\z", ""))
    ending = F.regexp_replace(word, r"[)\"']+\z", "").rlike(r"[.!?。！？]\z")
    abbreviation = bare.isin(*TOKEN_ABBREVIATIONS)
    initial = (F.length(F.regexp_replace(word, r"\.+\z", "")) == 1) & word.endswith(".")
    number = word.rlike(r"(?U)\A\d+\.\z") & F.coalesce(after.rlike(r"(?U)\A\d"), F.lit(False))
    return F.when(F.right(word, F.lit(1)).isin(*_LAST), ending & ~abbreviation & ~initial & ~number).otherwise(F.lit(False))


def sentences(text: Column | str) -> Column:
    """Sentences by tokens: one ends with a token that ends in a mark, unless it is an abbreviation, an initial, or a
    number before a number. Tokens are joined by one space. A token looks at its successor alone, so that all are
    marked at once and the sentences fall out of one split, in time linear in the text."""
    words = tokens(F.coalesce(text_column(text), F.lit("")))
    marked = let(words, lambda ws: F.transform(ws, lambda w, i: F.when(_ends(w, F.get(ws, i + 1)), F.concat(w, F.lit(_MARK))).otherwise(w)))
    return F.filter(F.split(F.array_join(marked, " "), _MARK + " ?", -1), lambda s: s != "")


def pattern_sentences(text: Column | str) -> Column:
    """Sentences by pattern: cut at white space after a mark and before a capital A-Z, but not after an abbreviation.

    One split does it: the white space must follow a mark and must not follow any of the abbreviations.
    """
    abbreviations = "|".join(re.escape(w) for w in LITERAL_ABBREVIATIONS)
    text = strip(F.coalesce(text_column(text), F.lit("")))
    return F.filter(F.split(text, rf"(?U)(?<=[.!?])(?<!{abbreviations}){SPACE}+(?=[A-Z])", -1), lambda s: s != "")


def sentence_count(text: Column | str) -> Column:
    """The number of parts between runs of marks that are not blank."""
    parts = F.split(F.coalesce(text_column(text), F.lit("")), r"[.!?]+", -1)
    return F.size(F.filter(parts, lambda s: strip(s) != "")).cast("long")


def reading_complexity(text: Column | str, digits: int | None = 2) -> Column:
    """struct(avg_word_length, avg_sentence_length, long_word_ratio, complexity_score), each rounded to ``digits`` places."""
    text = text_column(text)
    words = tokens(F.coalesce(text, F.lit("")))
    n = F.size(words)
    lengths = F.transform(words, lambda w: F.length(F.regexp_replace(w, r"""\A[.,!?;:"'\-()\[\]{}]+|[.,!?;:"'\-()\[\]{}]+\z""", "")))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    word = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    sentence = F.coalesce(F.try_divide(n, F.size(sentences(text))), F.lit(0.0))
    long = F.coalesce(F.try_divide(F.size(F.filter(lengths, lambda x: x > 6)), n), F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), word / 10.0 * 0.3 + sentence / 30.0 * 0.3 + long * 0.4))
    values = {"avg_word_length": word, "avg_sentence_length": sentence, "long_word_ratio": long, "complexity_score": score}
    return F.struct(*((v if digits is None else F.bround(v, digits)).alias(k) for k, v in values.items()))

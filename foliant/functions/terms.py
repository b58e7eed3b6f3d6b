"""Key terms, n-grams and lengths of texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.sentences import sentence_count
from foliant.functions.text import let, strip, text_column, tokens

# Words that are no key terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did "
    "will would could should may might must shall can need this that these those it its they them their what "
    "which who whom when where why how all each every both few more most other some such no not only own same "
    "so than too very just also into over after before between through during about being here there then now "
    "any because while although"
).split()


def plain_words(text: Column | str) -> Column:
    """Lower-cased words of a-z and 0-9, in order; words that hold other letters, digits or underscores are left out."""
    parts = F.split(F.lower(F.coalesce(text_column(text), F.lit(""))), r"[^\p{L}\p{N}_]+", -1)
    return F.filter(parts, lambda w: w.rlike(r"\A[a-z0-9]+\z"))


def key_terms(text: Column | str, least: int = 4) -> Column:
    """The distinct plain words of ``least`` characters or more that are not stop words."""
    return F.array_distinct(F.filter(plain_words(text), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS)))


def ngrams(text: Column | str, n: int = 2) -> Column:
    """The distinct sequences of ``n`` plain words, joined by spaces."""

    def grams(words: Column) -> Column:
        last = F.size(words) - n
        places = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " ")))

    return let(plain_words(text), grams)


def text_length(text: Column | str) -> Column:
    """struct(chars, words, sentences) of the stripped text."""
    text = F.coalesce(text_column(text), F.lit(""))
    return F.struct(F.length(strip(text)).cast("long").alias("chars"), F.size(tokens(text)).cast("long").alias("words"), sentence_count(text).alias("sentences"))

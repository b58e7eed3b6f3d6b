"""Chunking: one text to an ordered array of chunks, as Columns.

Each strategy is a composition of splits and ordered folds over arrays, so that a whole corpus is chunked in the
scan's own stage, without an exchange and without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.sentences import pattern_sentences, sentences
from foliant.functions.text import NOT_SPACE, let, strip, text_column, tokens
from foliant.functions.vectors import cosine, neighbour_cosines

# Where the recursive strategy cuts, in order of preference.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
_MARK = "\u001e"
_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _fold(pieces: Column, fits: Callable, joined: Callable, flush: Callable, oversized: Callable | None = None) -> Column:
    """Greedy packing: a piece joins the open chunk if it ``fits``; otherwise the chunk is flushed and the piece opens one."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        done = F.concat(s["done"], flush(s["open"]))
        new = F.struct(done.alias("done"), x.alias("open"))
        if oversized is not None:
            alone = F.struct(F.concat(done, oversized(x)[1]).alias("done"), F.lit("").alias("open"))
            new = F.when(oversized(x)[0], alone).otherwise(new)
        return F.when(fits(s["open"], x), F.struct(s["done"].alias("done"), joined(s["open"], x).alias("open"))).otherwise(new)

    return F.aggregate(pieces, start, step, lambda s: F.concat(s["done"], flush(s["open"])))


def _spaced(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))


def _spaced_length(a: Column, b: Column) -> Column:
    return F.when(a == "", F.length(b)).otherwise(F.length(a) + F.length(b) + 1)


def packed(pieces: Column, size: int) -> Column:
    """Pieces joined by single spaces into chunks of at most ``size``; a longer piece is a chunk of its own."""
    return _fold(pieces, lambda a, x: _spaced_length(a, x) <= size, _spaced, lambda a: F.when(a != "", F.array(strip(a))).otherwise(_empty()))


def forced(text: Column, size: int) -> Column:
    """Windows of ``size`` characters, stripped; blank ones are dropped. All are cut in one pass over the text."""
    return F.filter(F.transform(_parts(text, size), strip), lambda c: c != "")


def _parts(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"((?s:.{{1,{size}}}))"), 1)


def _checked(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if overlap < 0:
        raise ValueError("the overlap must not be negative")
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")


def _packed_at(text: Column, separator: str, size: int) -> Column:
    """The text cut before separators, greedily: a part reaches to the last separator within ``size``, or else to the next one.

    One search does it, without an object for each piece. Separators do not overlap; where one can overlap itself in the text, the pieces are
    split and folded.
    """
    end = rf"(?=\Q{separator}\E|\z)"
    found = F.regexp_extract_all(text, F.lit(rf"((?s:.{{1,{size}}}){end}|(?s:.{{{size + 1},}}?){end})"), 1)
    if separator[1:] != separator[:-1] or len(separator) == 1:
        return found
    parts = F.transform(F.split(text, rf"\Q{separator}\E", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x)))
    folded = _fold(parts, lambda a, x: F.length(a) + F.length(x) <= size, F.concat, lambda a: F.when(a != "", F.array(a)).otherwise(_empty()))
    return F.when(F.contains(text, F.lit(separator + separator[0])), folded).otherwise(found)


def recursive_chunks(text: Column | str, size: int = 512, overlap: int = 50) -> Column:
    """Chunks cut at the best separator that makes them fit; a separator stays with the piece after it.

    A text of at most ``size`` is one chunk as it is. There are as many levels as separators: each cuts what is
    still too long at its own separator and packs the pieces; what no separator cuts is cut by length.
    """
    _checked(size, overlap)
    text = F.coalesce(text_column(text), F.lit(""))
    # A piece longer than the size stays as it is for the next separator; one that is blank is dropped.
    tidy = lambda a: F.when(F.length(a) <= size, strip(a)).when(a.rlike(NOT_SPACE), a).otherwise("")

    def cut(p: Column, separator: str) -> Column:
        return F.filter(F.transform(_packed_at(p, separator, size), tidy), lambda c: c != "")

    def level(chunks: Column, split: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(chunks, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(split(p))))

    chunks = F.array(text)
    for separator in SEPARATORS:
        chunks = level(chunks, partial(cut, separator=separator))
    chunks = level(chunks, partial(forced, size=size))
    chunks = F.when(F.length(text) <= size, F.array(text)).otherwise(with_overlap(chunks, overlap) if overlap else chunks)
    return F.when(strip(text) == "", _empty()).otherwise(chunks)


def with_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first begins with the last characters of the one before it and a space."""
    lapped = lambda before, c: strip(F.concat(F.right(before, F.lit(overlap)), F.lit(" "), c))
    return let(chunks, lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, c).otherwise(lapped(F.get(cs, i - 1), c))))


def with_word_overlap(chunks: Column, overlap: int) -> Column:
    """As ``with_overlap``, from the first space on if there is one after the first character, behind three dots."""

    def head(before: Column) -> Column:
        tail = F.right(before, F.lit(overlap))
        at = F.locate(" ", tail)
        cut = F.when(at > 1, strip(F.substring(tail, at, F.length(tail)))).otherwise(tail)
        return F.when(F.length(before) >= overlap, cut).otherwise(before)

    return let(chunks, lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, c).otherwise(strip(F.concat(F.lit("..."), head(F.get(cs, i - 1)), F.lit(" "), c)))))


def sentence_chunks(text: Column | str, size: int = 512, overlap: int = 50) -> Column:
    """Whole sentences (by pattern) packed into chunks; a sentence longer than ``size`` stands alone."""
    _checked(size, overlap)
    text = F.coalesce(text_column(text), F.lit(""))
    chunks = packed(pattern_sentences(text), size)
    chunks = with_word_overlap(chunks, overlap) if overlap else chunks
    whole = let(strip(text), lambda t: F.when(t == "", _empty()).otherwise(F.array(t)))
    return F.when(F.length(text) <= size, whole).otherwise(let(chunks, lambda cs: F.when(F.size(cs) == 0, whole).otherwise(cs)))


@dataclass(frozen=True)
class Semantic:
    """Settings of the semantic strategy; those out of range fall back as ``fixed`` says."""

    threshold: float = 0.75
    least: int = 100
    most: int = 1000

    def fixed(self) -> Semantic:
        threshold = self.threshold if 0 <= self.threshold <= 1 else 0.75
        return Semantic(threshold, self.most // 4 if self.least >= self.most else self.least, self.most)


def long_sentences(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: F.length(strip(s)) > 10)


def by_words(text: Column, most: int) -> Column:
    return packed(tokens(text), most)


def grouped(items: Column, most: int) -> Column:
    """Sentences packed up to ``most``; one that is longer is packed by words."""
    return _fold(
        items,
        lambda a, x: _spaced_length(a, x) <= most,
        _spaced,
        lambda a: F.when(a != "", F.array(strip(a))).otherwise(_empty()),
        lambda x: (F.length(x) > most, by_words(x, most)),
    )


def merged_small(chunks: Column, least: int, most: int) -> Column:
    """Chunks under ``least`` joined to the next one where the result fits, and a small last one to the one before."""
    start = F.struct(_empty().alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, x: Column) -> Column:
        both = F.concat(s["open"], F.lit(" "), x)
        joins = (F.length(s["open"]) < least) & (F.length(both) <= most)
        return (
            F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open")))
            .when(joins, F.struct(s["done"].alias("done"), both.alias("open")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open")))
        )

    def end(s: Column) -> Column:
        last = F.try_element_at(s["done"], F.lit(-1))
        both = F.concat(last, F.lit(" "), s["open"])
        tail = F.when(
            (F.size(s["done"]) > 0) & (F.length(s["open"]) < least) & (F.length(both) <= most),
            F.concat(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(both)),
        ).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.when(s["open"].isNull(), s["done"]).otherwise(tail)

    return F.aggregate(chunks, start, step, end)


def fallback_chunks(text: Column | str, how: Semantic = Semantic()) -> Column:
    """What the semantic strategy does without embeddings: sentences (by tokens) packed, small chunks merged."""
    how, text = how.fixed(), F.coalesce(text_column(text), F.lit(""))
    chunks = let(long_sentences(text), lambda items: F.when(F.size(items) == 0, by_words(text, how.most)).otherwise(merged_small(grouped(items, how.most), how.least, how.most)))
    whole = F.when(strip(text) == "", _empty()).otherwise(F.array(strip(text)))
    return F.when(F.length(text) <= how.most, whole).otherwise(chunks)


def segments(items: Column, vectors: Column, threshold: float) -> Column:
    """Runs of neighbouring items joined by spaces; a run ends where the cosine of two neighbours is under the threshold."""
    alike = let(vectors, lambda vs: F.transform(vs, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(cosine(F.get(vs, i - 1), v))))
    return segments_by(items, alike, threshold)


def segments_by(items: Column, alike: Column, threshold: float) -> Column:
    """``segments`` of items whose likeness with the one before is known."""
    cut = lambda a, i: (i > 0) & (F.get(a, i) < threshold)
    marked = let(alike, lambda a: F.transform(items, lambda s, i: F.when(cut(a, i), F.concat(F.lit(_MARK), s)).otherwise(s)))
    return F.filter(F.transform(F.split(F.array_join(marked, " "), f" ?{_MARK}", -1), strip), lambda c: c != "")


def _by_meaning(t: Column, runs: Column, unknown: Column, how: Semantic) -> Column:
    """Chunks of a text from its runs of like sentences; the fallback where the vector of one is not known."""

    def bounded(c: Column) -> Column:
        some = lambda own: F.when(F.size(own) <= 1, by_words(c, how.most)).otherwise(grouped(own, how.most))
        return F.when(F.length(c) <= how.most, F.array(c)).otherwise(let(long_sentences(c), some))

    parts = merged_small(F.flatten(F.transform(runs, bounded)), how.least, how.most)
    return F.when(unknown, fallback_chunks(t, how)).otherwise(parts)


def semantic_chunks(text: Column | str, embed: Callable[[Column], Column] | None, how: Semantic = Semantic()) -> Column:
    """Chunks that end where neighbouring sentences differ in meaning; ``embed`` makes a vector Column of a text Column.

    Without ``embed``, or where a sentence has no vector, the fallback applies. Two sentences or fewer are one chunk.
    """
    how = how.fixed()

    def by_meaning(t: Column) -> Column:
        if embed is None:
            return fallback_chunks(t, how)
        some = lambda items: F.when(F.size(items) <= 2, F.array(t)).otherwise(let(F.transform(items, embed), lambda vs: _by_meaning(t, segments(items, vs, how.threshold), F.exists(vs, lambda v: v.isNull()), how)))
        return let(long_sentences(t), some)

    whole = lambda t: F.when(t == "", _empty()).when(F.length(t) <= how.most, F.array(t)).otherwise(by_meaning(t))
    return let(strip(F.coalesce(text_column(text), F.lit(""))), whole)


def semantic_table(docs: DataFrame, text: str, embed_all: Callable[[Column], Column], how: Semantic = Semantic()) -> DataFrame:
    """``docs`` with _chunks, as ``semantic_chunks`` makes them; ``embed_all`` makes an array of vectors of an array of texts.

    The sentences of a text are embedded together, in its own row, so that the provider may be a Python function with a
    client, and nothing is exchanged. Only texts that are cut by meaning have sentences to embed.
    """
    rows = _sentences_of(docs, text, how)
    # A provider that compares the texts itself spares their vectors the way out of Python and back.
    own = getattr(getattr(embed_all, "__self__", None), "alike", None)
    alike = own(F.col("_asked")) if own is not None else neighbour_cosines(embed_all(F.col("_asked")))
    return _cut_between(rows.withColumn("_alike", alike), how)


def semantic_table_by(docs: DataFrame, text: str, alike: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], how: Semantic = Semantic()) -> DataFrame:
    """As ``semantic_table``, with the likeness of sentences from elsewhere, as from a table of vectors.

    ``alike`` makes (_row, _alike), the ``neighbour_cosines`` of each text, of all sentences (_row, _at, text). ``store`` writes rows and reads them
    again, so that the number given to each text stays the same. Texts are cut into sentences each time these are used: written beside their
    text they would take three times its disk.
    """
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = rows.join(alike(asked_sentences(rows, text, how, "_row")), "_row", "left")
    none = F.array().cast("array<double>")
    return _cut_between(_sentences_of(found, text, how).withColumn("_alike", F.coalesce("_alike", none)), how).drop("_row")


def asked_sentences(docs: DataFrame, text: str, how: Semantic = Semantic(), *rest: str) -> DataFrame:
    """(_at, text) of the sentences whose vectors the semantic strategy needs, with the columns ``rest``."""
    # As in chunk_rows, an inner explode would have the sentences made again for a filter.
    return _sentences_of(docs, text, how).select(*rest, F.posexplode_outer("_asked").alias("_at", "text")).where("_at is not null")


def _sentences_of(docs: DataFrame, text: str, how: Semantic) -> DataFrame:
    """Texts with their sentences (_items), and with those that are to be embedded (_asked): of texts that are cut by meaning."""
    how, none = how.fixed(), F.array().cast("array<string>")
    rows = docs.withColumn("_t", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_items", F.when(F.length("_t") > how.most, long_sentences(F.col("_t"))).otherwise(none))
    return rows.withColumn("_asked", F.when(F.size("_items") > 2, F.col("_items")).otherwise(none))


def _cut_between(rows: DataFrame, how: Semantic) -> DataFrame:
    how, t, items, alike = how.fixed(), F.col("_t"), F.col("_items"), F.col("_alike")
    chunks = F.when(t == "", _empty()).when((F.length("_t") <= how.most) | (F.size("_items") <= 2), F.array(t)).otherwise(
        _by_meaning(t, segments_by(items, alike, how.threshold), F.exists(alike, lambda a: a.isNull()), how)
    )
    return rows.withColumn("_chunks", chunks).drop("_t", "_items", "_asked", "_alike")


def chunk_column(text: Column | str, strategy: str = "recursive", size: int = 512, overlap: int = 50, embed: Callable[[Column], Column] | None = None, semantic: Semantic | None = None) -> Column:
    """Chunks by the named strategy: semantic, sentence, or recursive, which any other name means too."""
    if strategy == "semantic":
        return semantic_chunks(text, embed, semantic or Semantic())
    if strategy == "sentence":
        return sentence_chunks(text, size, overlap)
    return recursive_chunks(text, size, overlap)


#: Characters of the parts in which a text is searched for its chunks.
_PART = 8192


def with_offsets(text: Column, chunks: Column) -> Column:
    """Array of struct(text, index, start_char, end_char): each chunk is looked for after the start of the one before;
    one that is not found stands where the search began.

    A position in a long text is found by counting from its beginning. The text is parted once, and a chunk is looked for in
    the parts from where the search begins on that can hold it; in all the rest only if it is not there.
    """
    start = F.struct(F.array().cast("array<struct<text:string,index:int,start_char:int,end_char:int>>").alias("done"), F.lit(0).alias("at"))

    def found_at(parts: Column, c: Column, at: Column) -> Column:
        first = F.floor(at / _PART).cast("int")
        near = F.array_join(F.slice(parts, first + 1, F.ceil(F.length(c) / _PART).cast("int") + 2), "")
        place = F.position(c, near, at - first * _PART + 1)
        return F.when(place > 0, place + first * _PART).otherwise(F.position(c, text, at + 1))

    def step(parts: Column, length: Column) -> Callable[[Column, Column], Column]:
        def add(s: Column, c: Column) -> Column:
            place = F.when((s["at"] < length) & (c != ""), found_at(parts, c, s["at"])).otherwise(0)

            def item(found: Column) -> Column:
                at = F.when(found > 0, found - 1).otherwise(s["at"])
                made = F.struct(c.alias("text"), F.size(s["done"]).alias("index"), at.cast("int").alias("start_char"), (at + F.length(c)).cast("int").alias("end_char"))
                return F.struct(F.concat(s["done"], F.array(made)).alias("done"), (at + 1).cast("int").alias("at"))

            return let(place, item)

        return add

    return let(_parts(text, _PART), lambda ps: let(F.length(text), lambda n: F.aggregate(chunks, start, step(ps, n), lambda s: s["done"])))


def chunk_rows(docs: DataFrame, text: str = "text", embed_all: Callable[[Column], Column] | None = None, by_table: Callable[[DataFrame, str, Semantic], DataFrame] | None = None, **how) -> DataFrame:
    """One row for each chunk, with the columns of ``docs`` but the text: chunk_text, chunk_index, total_chunks.

    The semantic strategy takes ``by_table`` or ``embed_all`` where they are given; see ``semantic_table_by`` and ``semantic_table``.
    """
    rest = [c for c in docs.columns if c != text]
    if by_table is not None and how.get("strategy") == "semantic":
        made = by_table(docs, text, how.get("semantic") or Semantic())
    elif embed_all is not None and how.get("strategy") == "semantic":
        made = semantic_table(docs, text, embed_all, how.get("semantic") or Semantic())
    else:
        made = docs.select(*rest, chunk_column(F.col(text), **how).alias("_chunks"))
    # An inner explode would have the optimizer infer a filter on the chunks and push it below, where all are made again for it.
    rows = made.withColumn("total_chunks", F.size("_chunks")).select(*rest, "total_chunks", F.posexplode_outer("_chunks").alias("chunk_index", "chunk_text"))
    return rows.where("chunk_index is not null")

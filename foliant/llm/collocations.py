"""Phrases whose words occur together more often than apart, from position bitmaps of words.

The words of a task's texts are numbered by their place, with a gap between pieces, and a shard of them is kept vertically:
for each word a bitmap of its places, of which only the blocks of 16 places with a bit are held. A phrase is
extended by shifting its bitmap one place and taking it AND the bitmaps of the words that have bits in the same blocks;
what is left are the bitmaps of the longer phrases, and their bits are counted. No bit can be shifted into another
piece, as nothing follows the gap. Shards are extended on their own and counts summed over all of them: first words, then
pairs, then phrases of three words and more depth-first from each first word, along pairs that are frequent in the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, pick, stored, trim
from foliant.llm.word_arrays import batches_of_words, byte_classes, lower_ascii

#: What parts words, and what parts pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Places of one block of a bitmap, which is held as an unsigned number of so many bits.
BLOCK = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class Phrases:
    least: int = 100
    words: int = 5
    #: The first so many phrases of each language.
    top: int = 2000
    #: Places of a shard, and of all shards that a task fills at once. Only a text that is longer makes a larger one.
    places: int = 1 << 21
    #: Blocks of bitmaps that are extended at once.
    step: int = 50_000
    #: Words of the corpus for each bucket of phrases that are summed together.
    bucket: int = 1 << 21


_SHARD = "lang string, shard bigint, words array<string>, counts array<bigint>, maps binary"
_SHARD_ARROW = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("maps", pa.binary())])


class _Builder:
    """The words of one language until they make a shard."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.places: list[np.ndarray] = []
        self.next, self.piece, self.size = 0, -1, 0

    def add(self, words: pa.Array, piece: np.ndarray, pieces: int) -> None:
        """``piece`` counts on from ``self.piece``, the piece of the last word so far; a new one leaves a gap."""
        if len(words):
            gaps = np.empty(len(words), np.int64)
            gaps[0] = piece[0] != self.piece
            gaps[1:] = piece[1:] != piece[:-1]
            places = self.next + np.arange(len(words)) + np.cumsum(gaps)
            self.words.append(words)
            self.places.append(places)
            self.next, self.size = int(places[-1]) + 1, self.size + len(words)
        self.piece = pieces

    def bitmaps(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, bits of each, blocks of each, numbers of these blocks, bits in them), word after word."""
        coded = pa.chunked_array(self.words).cast(pa.large_binary()).combine_chunks().dictionary_encode()
        which, places = np.asarray(coded.indices), np.concatenate(self.places)
        order = np.argsort(which, kind="stable")
        which, places = which[order], places[order]
        block = places // BLOCK
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        bits = np.bitwise_or.reduceat((1 << (places % BLOCK)).astype(np.uint16), at)
        n = len(coded.dictionary)
        return coded.dictionary, np.bincount(which, minlength=n), np.bincount(which[at], minlength=n), block[at], bits


def _shard_row(lang: str, shard: int, builder: _Builder) -> pa.RecordBatch:
    words, counts, blocks, at, bits = builder.bitmaps()
    # Differences of block numbers are small, and compress: a word's first block is counted from 0.
    steps = np.diff(at, prepend=0)
    first = np.cumsum(blocks) - blocks
    steps[first] = at[first]
    one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
    maps = _packed(blocks.astype("<u4"), steps.astype("<u4"), bits.astype("<u2"))
    return pa.record_batch([pa.array([lang]), pa.array([shard]), one(words, pa.string()), one(counts, pa.int64()), pa.array([maps], pa.binary())], schema=_SHARD_ARROW)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed string; the bytes of one place of all numbers stand together, as most are 0."""
    parts = [c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    sizes = np.array([len(parts), *(len(p) for p in parts)], "<u8").tobytes()
    return sizes + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u8", 1 + len(kinds))[1:].astype(np.int64)
    flat = np.frombuffer(pa.decompress(data[8 * (1 + len(kinds)) :], int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + size].reshape(width, -1).T).view(kind).ravel())
        at += size
    return out


def shards(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """The words of every whole text as bitmaps, one row for each shard of a task's texts of one language.

    A null text is empty; null languages are ``und``. Texts without words are in no shard. Numbers of shards hold the
    task's number, so that the result is to be stored before it is joined with itself.
    """
    rows = pick(docs, "text", "lang").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")).where("text != ''")
    classes, lower = byte_classes(BLANKS, BREAKS), lower_ascii()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Builder] = {}
        number, total = TaskContext.get().partitionId() << 32, 0
        for batch, found in batches_of_words(batches, "text", classes, lower):
            coded = batch.column("lang").dictionary_encode()
            of_row, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            of_word = of_row[found.row]
            for k, lang in enumerate(names):
                if not found.continued:  # a text is begun: shards end between texts
                    full = held.get(lang)
                    if full is not None and full.size >= how.places:
                        yield _shard_row(lang, number, held.pop(lang))
                        number, total = number + 1, total - full.size
                builder = held.setdefault(lang, _Builder())
                own = of_word == k
                base = builder.piece + (not found.continued)
                builder.add(found.words.filter(pa.array(own)), found.piece[own] + base, found.pieces - 1 + base)
                total += int(own.sum())
            while not found.continued and total >= 2 * how.places and len(held) > 1:
                lang = max(held, key=lambda x: (held[x].size, x))
                total -= held[lang].size
                yield _shard_row(lang, number, held.pop(lang))
                number += 1
        for lang, builder in held.items():
            if builder.size:
                yield _shard_row(lang, number, builder)
                number += 1
        trim()

    return rows.mapInArrow(build, _SHARD)


class Bitmaps:
    """The bitmaps of a shard's frequent words, found by word and by block."""

    def __init__(self, maps: bytes, words: np.ndarray) -> None:
        """``words`` are the places of the frequent words in the shard's list, ascending; they are known by their rank there."""
        blocks, steps, bits = _unpacked(maps, "<u4", "<u4", "<u2")
        blocks, steps = blocks.astype(np.int64), np.cumsum(steps, dtype=np.int64)
        ends = np.cumsum(blocks)
        sizes = blocks[words]
        done = np.cumsum(sizes)
        places = np.repeat(ends[words] - sizes - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)
        begins = ends[words] - sizes
        before = np.where(begins > 0, steps[np.maximum(begins - 1, 0)], 0)
        self.at = (steps[places] - np.repeat(before, sizes)).astype(np.int64)
        self.bits = bits[places].astype(np.uint32)
        self.ends = np.concatenate([[0], done])
        self.word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        order = np.argsort(self.at, kind="stable")
        n = int(self.at.max()) + 3 if len(self.at) else 2
        self.block_ends = np.concatenate([[0], np.cumsum(np.bincount(self.at, minlength=n))])
        self.block_word, self.block_bits = self.word[order], self.bits[order]

    def extended(self, node: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, word, block, bits) where the bitmaps of nodes, moved on by one place, share bits with those of words."""
        moved = bits << 1
        inside, over = moved & ((1 << BLOCK) - 1), moved >> BLOCK
        a, b = np.flatnonzero(inside), np.flatnonzero(over)
        node, at, bits = np.concatenate([node[a], node[b]]), np.concatenate([at[a], at[b] + 1]), np.concatenate([inside[a], over[b]])
        begins = self.block_ends[at]
        n = self.block_ends[at + 1] - begins
        done = np.cumsum(n)
        of = np.repeat(np.arange(len(at)), n)
        entry = (begins - (done - n))[of] + np.arange(int(done[-1]) if len(done) else 0)
        both = self.block_bits[entry] & bits[of]
        hit = np.flatnonzero(both)
        of, entry = of[hit], entry[hit]
        return node[of], self.block_word[entry], at[of], both[hit]


def _children(node: np.ndarray, word: np.ndarray, at: np.ndarray, bits: np.ndarray, n_words: int) -> tuple[np.ndarray, ...]:
    """Bitmaps grouped by node and next word: (node, word, how many bits) of each child, and (child, block, bits) of all."""
    order = np.argsort(node * n_words + word, kind="stable")
    node, word, at, bits = node[order], word[order], at[order], bits[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
    begin = np.flatnonzero(new)
    counts = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return node[begin], word[begin], counts, np.cumsum(new) - 1, at, bits


def _roots(maps: Bitmaps, words: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Words in parts whose bitmaps have about ``step`` blocks together."""
    sizes = maps.ends[words + 1] - maps.ends[words]
    part = (np.cumsum(sizes) - sizes) // step
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from (x for x in np.split(words, cuts) if len(x))


def _of_words(maps: Bitmaps, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, bits) of the bitmaps of ``words``, as nodes of one word."""
    begins, sizes = maps.ends[words], maps.ends[words + 1] - maps.ends[words]
    done = np.cumsum(sizes)
    places = np.repeat(begins - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)
    return maps.word[places], maps.at[places], maps.bits[places]


#: A packed table: what is counted in one shard and falls into one bucket, or the frequent pairs of a shard.
_COUNTED = "bucket int, shard bigint, data binary"
_COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("data", pa.binary())])
_PHRASE = "ids array<int>, f bigint"
_FREQUENT = f"shard bigint, data binary, {_PHRASE}"
_PHRASE_ARROW = pa.schema([("ids", pa.list_(pa.int32())), ("f", pa.int64())])
_FREQUENT_ARROW = pa.schema([("shard", pa.int64()), ("data", pa.binary()), *_PHRASE_ARROW])
_NONE = 0xFFFFFFFF


def _bucketed(names: np.ndarray, n: np.ndarray, shard: int, buckets: int) -> pa.Table:
    """Phrases (lines of word ids, ended by _NONE) and their counts, packed bucket by bucket."""
    hashed = np.zeros(len(names), np.uint64)
    for column in names.T:
        hashed = (hashed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    bucket = (hashed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    rows = [(k, order[end - size : end]) for k, (end, size) in enumerate(zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)) if size]
    data = [_packed(*(names[at, c] for c in range(names.shape[1])), n[at].astype("<u4")) for _, at in rows]
    return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array(data, pa.binary())], schema=_COUNTED_ARROW)


def _summed(parts: list[bytes], words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(lines of word ids, sums, the line of each entry, entries) of packed phrases, of those with ``least`` at least; -1 is no line."""
    columns = [_unpacked(d, *["<u4"] * (words + 1)) for d in parts]
    *names, n = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.lexsort(names[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in names], axis=0)
    begin = np.flatnonzero(new)
    sums = np.add.reduceat(n[order].astype(np.int64), begin)
    kept = np.flatnonzero(sums >= least)
    line = np.full(len(sums), -1)
    line[kept] = np.arange(len(kept))
    of = np.empty(len(order), np.int64)
    of[order] = line[np.cumsum(new) - 1]
    return np.column_stack([c[order[begin[kept]]] for c in names]), sums[kept], of, names


def _lists(names: np.ndarray) -> pa.Array:
    there = names != _NONE
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(names[there].astype(np.int32)))


_WORDS = "shard bigint, data binary, lang string, word string, f bigint, id int"
_WORDS_ARROW = pa.schema([("shard", pa.int64()), ("data", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("id", pa.int32())])


def _with_nulls(schema: pa.Schema, **columns: pa.Array) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _by_shard(shard: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(shards, packed columns of each)."""
    order = np.argsort(shard, kind="stable")
    values, begin = np.unique(shard[order], return_index=True)
    data = [_packed(*(c[at].astype("<u4") for c in columns)) for at in np.split(order, begin[1:])] if len(order) else []
    return pa.array(values, pa.int64()), pa.array(data, pa.binary())


def frequent_words(held: DataFrame, buckets: int, how: Phrases = Phrases()) -> DataFrame:
    """Rows (lang, word, f, id) of the words that are frequent in the whole, and rows (shard, data) of where they are in a shard's list.

    Words are dealt into buckets by a hash, and numbered in their bucket, buckets in turn: a number takes 31 bits.
    """
    listed = held.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "_w")).select("lang", "shard", "at", F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))

    def total(table: pa.Table) -> pa.Table:
        codes = [table[c].combine_chunks().dictionary_encode() for c in ("lang", "word")]
        langs, words = (c.dictionary for c in codes)
        key = np.asarray(codes[0].indices).astype(np.int64) * len(words) + np.asarray(codes[1].indices)
        # Numbers must not depend on the order of rows: a repeat after a lost executor has to give the same ones.
        names, line = np.unique(key, return_inverse=True)
        f = np.bincount(line, weights=table["n"].to_numpy(), minlength=len(names)).astype(np.int64)
        kept = np.flatnonzero(f >= how.least)
        lang, word = langs.take(pa.array(names[kept] // len(words))), words.take(pa.array(names[kept] % len(words)))
        order = pa.compute.sort_indices(pa.table({"lang": lang, "word": word}), [("lang", "ascending"), ("word", "ascending")]).to_numpy()
        number = np.full(len(names), -1)
        number[kept[order]] = np.arange(len(kept)) * buckets + table["bucket"][0].as_py()
        if number.max(initial=0) >= (1 << 31) - 1:
            raise ValueError("too many frequent words")
        own = np.flatnonzero(number[line] >= 0)
        shard, data = _by_shard(table["shard"].to_numpy()[own], table["at"].to_numpy()[own], number[line[own]])
        trim()
        whole = _with_nulls(_WORDS_ARROW, lang=lang, word=word, f=pa.array(f[kept]), id=pa.array(number[kept].astype(np.int32)))
        return pa.concat_tables([whole, _with_nulls(_WORDS_ARROW, shard=shard, data=data)])

    return listed.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))).groupBy("bucket").applyInArrow(total, _WORDS)


def _places(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places in the shard's list, word ids), by places ascending."""
    at, ids = (np.concatenate(c) for c in zip(*(_unpacked(d, "<u4", "<u4") for d in packed), strict=True))
    order = np.argsort(at)
    return at[order].astype(np.int64), ids[order]


def pairs(held: DataFrame, known: DataFrame, buckets: int, how: Phrases = Phrases()) -> DataFrame:
    """(bucket, shard, data): how often a shard has each pair of frequent words, packed.

    ``held`` are shards, ``known`` (shard, data) the frequent words of each with their place in its list.
    """

    def count(shard: pa.Table, words: pa.Table) -> pa.Table:
        if not len(shard) or not len(words):
            return _COUNTED_ARROW.empty_table()
        at, ids = _places(words["data"].to_pylist())
        maps = Bitmaps(shard["maps"][0].as_py(), at)
        names, counts = [], []
        for some in _roots(maps, np.arange(len(ids)), how.step):
            node, word, n, *_ = _children(*maps.extended(*_of_words(maps, some)), len(ids))
            names.append(np.column_stack([ids[node], ids[word]]))
            counts.append(n)
        out = _bucketed(np.concatenate(names), np.concatenate(counts), shard["shard"][0].as_py(), buckets)
        trim()
        return out

    return held.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(count, _COUNTED)


def frequent_pairs(counted: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """Of ``pairs``: rows (ids, f) of the pairs that are frequent in the whole, and rows (shard, data) of those that a shard has."""

    def total(table: pa.Table) -> pa.Table:
        names, f, line, entries = _summed(table["data"].to_pylist(), 2, how.least)
        sizes = [int(np.frombuffer(d.as_py()[:16], "<u8")[1]) // 4 for d in table["data"]]
        own = np.flatnonzero(line >= 0)
        shard, data = _by_shard(np.repeat(table["shard"].to_numpy(), sizes)[own], entries[0][own], entries[1][own])
        trim()
        return pa.concat_tables([_with_nulls(_FREQUENT_ARROW, ids=_lists(names), f=pa.array(f)), _with_nulls(_FREQUENT_ARROW, shard=shard, data=data)])

    return counted.groupBy("bucket").applyInArrow(total, _FREQUENT)


def phrases(held: DataFrame, known: DataFrame, there: DataFrame, buckets: int, how: Phrases = Phrases()) -> DataFrame:
    """(bucket, shard, data): how often a shard has each phrase of three words and more all of whose pairs are frequent, packed.

    ``there`` (shard, data) has the frequent pairs that occur in a shard, ``known`` is as in ``pairs``.
    """

    def count(shard: pa.Table, facts: pa.Table) -> pa.Table:
        packed = {two: facts.filter(pa.compute.equal(facts["two"], two))["data"].to_pylist() for two in (False, True)}
        if not len(shard) or not packed[True]:
            return _COUNTED_ARROW.empty_table()
        place, every = _places(packed[False])
        order = np.argsort(every)
        first, second = (np.concatenate(c) for c in zip(*(_unpacked(d, "<u4", "<u4") for d in packed[True]), strict=True))
        at = place[order][np.searchsorted(every[order], np.concatenate([first, second]))]
        chosen, rank = np.unique(at, return_inverse=True)
        ids = np.empty(len(chosen), np.uint32)
        ids[rank] = np.concatenate([first, second])
        maps, n_words = Bitmaps(shard["maps"][0].as_py(), chosen), len(chosen)
        allowed = np.unique(rank[: len(first)] * n_words + rank[len(first) :])

        def along_pairs(last: np.ndarray, node: np.ndarray, word: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
            key = last[node] * n_words + word
            place = np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)
            keep = allowed[place] == key
            return node[keep], word[keep], at[keep], bits[keep]

        found, counts = [], []
        for some in _roots(maps, np.unique(allowed // n_words), how.step):
            entries = _of_words(maps, some)
            names = np.arange(n_words)[:, None]  # the words of each node
            for length in range(2, how.words + 1):
                hits = along_pairs(names[:, -1], *maps.extended(*entries))
                parent, word, n, *entries = _children(*hits, n_words)
                names = np.column_stack([names[parent], word])
                if not len(n):
                    break
                if length > 2:
                    found.append(np.column_stack([ids[names], np.full((len(n), how.words - length), _NONE, np.uint32)]))
                    counts.append(n)
        if not found:
            return _COUNTED_ARROW.empty_table()
        out = _bucketed(np.concatenate(found), np.concatenate(counts), shard["shard"][0].as_py(), buckets)
        trim()
        return out

    facts = known.withColumn("two", F.lit(False)).unionByName(there.withColumn("two", F.lit(True)))
    return held.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(count, _COUNTED)


def frequent_phrases(counted: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """(ids, f) of the phrases of ``phrases`` that are frequent in the whole."""

    def total(table: pa.Table) -> pa.Table:
        names, f, *_ = _summed(table["data"].to_pylist(), how.words, how.least)
        trim()
        return pa.table([_lists(names), pa.array(f)], schema=_PHRASE_ARROW)

    return counted.groupBy("bucket").applyInArrow(total, _PHRASE)


def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of long columns: products have up to 38 digits, the quotient is a long."""
    return F.expr(f"(1000 * cast({a} as decimal(16,0)) * cast({n} as decimal(17,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    Words are lower-cased (A to Z) and parted at blanks and tabs, pieces at punctuation and line ends; everything is counted for
    each language (null: ``und``) over all whole texts. Phrases have 2 to ``how.words`` words and occur ``how.least``
    times or more, within pieces, overlaps included. A phrase is scored by its lowest cut, ties to the
    shorter first part, and dropped if it lies in a longer candidate that occurs as often. Null and empty texts have no words; repeated
    rows count each time; an empty table gives no rows. Arithmetic is exact, in integers of 38 digits.
    """
    held = stored(shards(docs, how), "shards")
    totals = stored(held.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    # Each word and phrase of a shard falls into one of so many buckets by a hash; a bucket is summed in one task.
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // how.bucket))
    facts = stored(frequent_words(held, buckets, how), "words")
    words, known = facts.where("f is not null").select("lang", "word", "f", "id"), facts.where("data is not null").select("shard", "data")
    some = stored(frequent_pairs(pairs(held, known, buckets, how), how), "pairs")
    two = some.where("f is not null").select("ids", "f")
    longer = frequent_phrases(phrases(held, known, some.where("data is not null").select("shard", "data"), buckets, how), how)
    counted = stored(two.unionByName(longer), "phrases")
    discard(held, some)

    # A longer phrase that occurs as often has its parts of one word less occur as often, so that those are enough to look at.
    inner = counted.where(F.size("ids") > 2).select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.col("f").alias("most"))
    kept = counted.join(inner.groupBy("ids").agg(F.max("most").alias("most")), "ids", "left").where("most is null or most < f").select("ids", F.col("f").alias("a"))
    spelt = kept.select("ids", "a", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word", "lang"), "id")
    spelt = spelt.groupBy("ids", "a").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    every = counted.unionByName(words.select(F.array("id").alias("ids"), "f"))
    cuts = spelt.join(totals, "lang").select("*", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    for side, part in (("l", "slice(ids, 1, k)"), ("r", "slice(ids, k + 1, size(ids))")):
        cuts = cuts.withColumn("_part", F.expr(part)).join(every.select(F.col("ids").alias("_part"), F.col("f").alias(side)), "_part").drop("_part")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("_cut"))
    scored = lowest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    out = stored(_first(scored, how.top), "collocations")
    discard(totals, facts, counted)
    return out


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language: first within parts of a language, whose number follows its share, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = scored.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

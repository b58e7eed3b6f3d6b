"""Which documents contain which passages, as ground truth for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, tokens

#: The most words of a key. A key leaves out a passage's first and last word, which may be parts of a document's words.
KEY = 5
#: Bits that say which keys occur in passages. A key that shares a bit with another costs a row and changes nothing.
BITS = 1 << 20


def _keys(words: Column, size: int) -> Column:
    """Hashes of every ``size`` successive words, each once; none of shorter texts."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "), F.lit(size)))
    return F.when(F.size(words) >= size, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))


def _wanted(keys: DataFrame) -> Column:
    """The bits of all keys (_k) as an array of ``BITS`` / 64 numbers, which is a scalar however many keys there are."""
    bit = F.pmod("_k", F.lit(BITS))
    words = keys.groupBy((bit / 64).cast("int").alias("_at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_k, {BITS}) % 64 as int))")).alias("_bits"))
    held = words.agg(F.map_from_entries(F.collect_list(F.struct("_at", "_bits"))).alias("_m"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long")))).scalar()


def _by_parts(short: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, _k) of passages of one or two words: keys of the corpus's words that hold the longest of them.

    Each distinct word of the corpus meets passages by three characters (two or one for shorter passages).
    """
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    parts = short.select("item_id", longest.alias("_part")).withColumn("_n", F.least(F.length("_part"), F.lit(3))).withColumn("_gram", F.substring("_part", 1, 3))
    sizes = [r["_n"] for r in parts.select("_n").distinct().collect()]  # at most 1, 2 and 3
    words = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("_word")).distinct()
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("_word") - n + 1), lambda i: F.substring(F.col("_word"), i, F.lit(n)))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(none, *(F.when(F.length("_word") >= n, grams(n)).otherwise(none) for n in sizes)))
    met = words.select("_word", F.explode(every).alias("_gram")).join(parts, "_gram").where(F.contains("_word", "_part"))
    return met.select("item_id", F.xxhash64(F.array_join(F.array("_word"), " "), F.lit(1)).alias("_k"))


def passage_hits(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the text of a passage (item_id, text) stands in that of a document (doc_id, text).

    Passages and documents meet by the hash of up to five words that a passage has after its first one; those of one or two
    words, which have none, by the words of the corpus that hold the longer one. A document gives only the keys whose bits are set
    by passages, and only documents with such keys are exchanged; texts are compared in full then. Blank and null
    passages hit nothing; repeated rows hit once.
    """
    asked = passages.select("item_id", F.col("text").alias("_p"), tokens("text").alias("_w")).where(F.size("_w") > 0)
    size = F.least(F.size("_w") - 2, F.lit(KEY))
    sizes = {max(r["n"], 1) for r in asked.select(F.greatest(size, F.lit(0)).alias("n")).distinct().collect()}  # at most KEY of them
    key = F.xxhash64(F.array_join(F.slice("_w", F.lit(2), size), " "), size)
    keyed = asked.where(size > 0).select("item_id", key.alias("_k"))
    short = asked.where(size <= 0)
    if not short.isEmpty():
        keyed = keyed.unionByName(_by_parts(short, docs))
    bits = _wanted(keyed)
    here = let(tokens("text"), lambda w: F.concat(F.array().cast("array<bigint>"), *(_keys(w, n) for n in sorted(sizes))))
    held = docs.select("doc_id", "text", here.alias("_ks"), bits.alias("_bits")).select("doc_id", "text", F.filter("_ks", lambda k: _is_set(F.col("_bits"), k)).alias("_ks"))
    # explode_outer, since explode would be given a filter that computes the keys once more
    near = held.select("doc_id", F.explode_outer("_ks").alias("_k")).join(keyed, "_k").select("doc_id", "item_id").distinct()
    found = near.join(held.where(F.size("_ks") > 0).select("doc_id", "text"), "doc_id").join(asked.select("item_id", "_p"), "item_id").where(F.contains("text", "_p"))
    return found.select("item_id", "doc_id").distinct()


def _is_set(bits: Column, key: Column) -> Column:
    at = F.pmod(key, F.lit(BITS))
    return F.getbit(F.get(bits, (at / 64).cast("int")), (at % 64).cast("int")) == 1

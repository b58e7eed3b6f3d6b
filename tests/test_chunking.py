"""Chunkers against an independent specification on random texts, and their edge cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions.vectors import neighbour_cosines
from foliant.operators import chunking
from foliant.providers import embedding
from foliant.providers.embedding import HashedTerms


def run(spark, rows, column):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def random_texts(n=60):
    random.seed(11)
    marks = [" ", " ", " ", ". ", "? ", "! ", "; ", ", ", "\n", "\n\n"]
    words = ["alpha", "be", "gamma-delta", "É", "漢字", "x" * 25, "no.", "Dr.", "End"]
    return ["".join(random.choice(words) + random.choice(marks) for _ in range(random.randint(0, 60))) for _ in range(n)]


def windows(s, size):
    return [w for i in range(0, len(s), size) if (w := s[i : i + size].strip())]


def spec_recursive(s, size, separators):
    """Cut at the first separator that occurs, pack greedily, and go on with the rest inside what is too long."""
    if len(s) <= size:
        return [s.strip()] if s.strip() else []
    while separators and separators[0] not in s:
        separators = separators[1:]
    if not separators:
        return windows(s, size)
    head, *tail = s.split(separators[0])
    groups = [head]
    for piece in (separators[0] + x for x in tail):
        if len(groups[-1]) + len(piece) <= size:
            groups[-1] += piece
        else:
            groups.append(piece)
    return [c for g in groups if g.strip() for c in spec_recursive(g, size, separators[1:])]


def test_recursive_matches_specification(spark):
    rows = random_texts()
    got = run(spark, rows, chunking.recursive_chunks("t", 40, 0))
    for row, chunks in zip(rows, got, strict=True):
        expected = ([row] if row.strip() else []) if len(row) <= 40 else spec_recursive(row, 40, list(chunking.SEPARATORS))
        assert chunks == expected
        assert all(len(c) <= 40 for c in chunks)


def test_recursive_edges(spark):
    rows = ["a" * 40, "a" * 41, "  short  ", "", None, " \n ", "," * 90]
    got = run(spark, rows, chunking.recursive_chunks("t", 40, 10))
    assert got[:6] == [["a" * 40], ["a" * 40, "a" * 10 + " a"], ["  short  "], [], [], []]
    with pytest.raises(ValueError):
        chunking.recursive_chunks("t", 10, 10)
    with pytest.raises(ValueError):
        chunking.recursive_chunks("t", 0, 0)


def test_sentence_chunks(spark):
    row = "First one here. Second one there. " + "Very long sentence " * 4 + "ends. Last."
    got = run(spark, [row], chunking.sentence_chunks("t", 40, 12))[0]
    assert got[0] == "First one here. Second one there."
    assert all(c.startswith("...") for c in got[1:])
    assert run(spark, [" x ", None], chunking.sentence_chunks("t", 40, 0)) == [["x"], []]


def spec_fallback(items, least, most):
    """Sentences packed, long ones by words, then small chunks merged with a neighbour."""

    def pack(parts):
        out = []
        for p in parts:
            if out and len(out[-1]) + 1 + len(p) <= most:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    groups, run_ = [], []
    for s in items:
        if len(s) > most:
            groups += pack(run_) + pack(s.split())
            run_ = []
        else:
            run_.append(s)
    groups += pack(run_)
    merged = []
    for g in groups:
        if merged and len(merged[-1]) < least and len(merged[-1]) + 1 + len(g) <= most:
            merged[-1] += " " + g
        else:
            merged.append(g)
    if len(merged) > 1 and len(merged[-1]) < least and len(merged[-2]) + 1 + len(merged[-1]) <= most:
        merged[-2:] = [merged[-2] + " " + merged[-1]]
    return merged


def test_fallback_matches_specification(spark):
    rows = [t for t in random_texts() if len(t) > 60]
    how = chunking.Semantic(least=20, most=60)
    items = run(spark, rows, chunking.long_sentences(F.col("t")))
    got = run(spark, rows, chunking.fallback_chunks("t", how))
    for row, sents, chunks in zip(rows, items, got, strict=True):
        if sents and len(row) > 60:
            assert chunks == spec_fallback(sents, 20, 60)


def test_semantic_chunks(spark):
    cats = "Cats purr and cats sleep all day long. " * 3
    cars = "Engines roar while engines burn petrol fast. " * 3
    rows = [cats + cars, "short", None, "One sentence that is rather long but single and without any stop " * 3]
    how = chunking.Semantic(threshold=0.5, least=20, most=150)
    got = run(spark, rows, chunking.semantic_chunks("t", HashedTerms(64).embed, how))
    assert got[0] == [cats.strip(), cars.strip()]
    assert got[1:3] == [["short"], []]
    assert len(got[3]) == 1
    assert run(spark, rows[:1], chunking.semantic_chunks("t", None, how)) == run(spark, rows[:1], chunking.fallback_chunks("t", how))


def test_settings_out_of_range_fall_back():
    assert chunking.Semantic(threshold=7, least=500, most=400).fixed() == chunking.Semantic(0.75, 100, 400)


def test_offsets(spark):
    frame = spark.createDataFrame([("abc abc abd",)], "t string")
    chunks = F.array(F.lit("abc"), F.lit("abc"), F.lit("missing"))
    got = frame.select(chunking.with_offsets(F.col("t"), chunks).alias("v")).first()["v"]
    assert [(c["start_char"], c["end_char"]) for c in got] == [(0, 3), (4, 7), (5, 12)]


def test_unknown_strategy_is_recursive(spark):
    rows = random_texts(5)
    assert run(spark, rows, chunking.chunk_column("t", "other", 40, 5)) == run(spark, rows, chunking.recursive_chunks("t", 40, 5))


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("a.txt", "one two three four five")], "source string, text string")
    got = chunking.chunk_rows(docs, strategy="recursive", size=10, overlap=0).orderBy("chunk_index").collect()
    assert [r["chunk_text"] for r in got] == ["one two", "three", "four five"]
    assert {r["total_chunks"] for r in got} == {3}


def topics():
    """A text of twelve sentences about two things, long enough to be cut by meaning."""
    cats = [f"The small cat number {i} sleeps on a warm and quiet window sill all day." for i in range(6)]
    boats = [f"Wooden boats like vessel {i} cross the northern harbour before the morning tide." for i in range(6)]
    return " ".join(cats + boats)


def test_semantic_chunks_of_a_remote_provider(spark):
    def by_topic():
        """A client that knows cats from boats, and fails now and then."""
        calls = []

        def client(texts):
            calls.append(list(texts))
            assert len(texts) <= 50 and len(set(texts)) == len(texts)
            if len(calls) % 2:
                raise RuntimeError("try again")
            return [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts]

        return client

    provider = embedding.Remote(by_topic, 2, wait=0.0)
    docs = spark.createDataFrame([(1, topics()), (2, "short"), (3, None), (4, " "), (5, topics())], "id int, text string")
    how = chunking.Semantic(0.75, 50, 700)
    got = {}
    for r in chunking.chunk_rows(docs, strategy="semantic", embed_all=provider.embed_all, semantic=how).collect():
        got.setdefault(r["id"], []).append(r["chunk_text"])
    assert got[1] == got[5] and len(got[1]) == 2 and "boat" not in got[1][0].lower() and "cat" not in got[1][1]
    assert got[2] == ["short"] and set(got) == {1, 2, 5}


def test_semantic_chunks_without_vectors_fall_back(spark):
    def client():
        def call(texts):
            raise RuntimeError("never")

        return call

    docs = spark.createDataFrame([(1, topics())], "id int, text string")
    how = chunking.Semantic(0.75, 50, 700)
    got = [r["chunk_text"] for r in chunking.chunk_rows(docs, strategy="semantic", embed_all=embedding.Remote(client, 2, attempts=2, wait=0.0).embed_all, semantic=how).collect()]
    assert got == docs.select(chunking.fallback_chunks("text", how).alias("c")).first()["c"]


def test_semantic_table_equals_the_column(spark):
    texts = [topics(), topics()[:300], "One. Two three.", "", None, topics().replace("cat", "123 !!"), "word " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    provider = embedding.HashedTerms(32)
    table = {r["id"]: r["_chunks"] for r in chunking.semantic_table(docs, "text", provider.embed_all).collect()}
    column = {r["id"]: r["c"] for r in docs.select("id", chunking.semantic_chunks("text", provider.embed).alias("c")).collect()}
    assert table == column


def test_calls_ask_once_and_keep_order():
    asked = []

    def client(texts):
        asked.extend(texts)
        return [[float(len(t))] if t != "odd" else [1.0, 2.0] for t in texts]

    calls = embedding.Calls(client, 1, batch=2, attempts=1, wait=0.0, remembered=3)
    assert calls.vectors(["a", None, "bb", "a", " ", "odd", "ccc"]) == [[1.0], None, [2.0], [1.0], None, None, [3.0]]
    assert calls.vectors(["bb", "dddd"]) == [[2.0], [4.0]] and asked == ["a", "bb", "odd", "ccc", "dddd"]
    calls.clear()
    assert calls.vectors(["bb"]) == [[2.0]] and asked[-1] == "bb"


def test_neighbour_cosines(spark):
    rows = [([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [0.0, 2.0]],), ([[1.0], None, [2.0]],), ([],), (None,), ([[3.0, 4.0], [3.0]],)]
    got = [r["v"] for r in spark.createDataFrame(rows, "x array<array<float>>").select(neighbour_cosines(F.col("x")).alias("v")).collect()]
    assert got[0] == [0.0, pytest.approx(0.5**0.5), 0.0, 0.0] and got[1] == [0.0, None, None] and got[2] == [] and got[3] is None and got[4] == [0.0, pytest.approx(0.6)]


@pytest.mark.parametrize("n", [1, 7, 256])
def test_hashed_terms_in_both_forms(spark, n):
    texts = ["the cat sat on the mat", "", " ", None, "éé 12 ab_c x9", "___", "Cat CAT cat ß K", "a " * 50]
    frame = spark.createDataFrame([(texts,)], "x array<string>")
    provider = embedding.HashedTerms(n)
    column, table = frame.select(F.transform("x", provider.embed).alias("a"), provider.embed_all(F.col("x")).alias("b")).first()
    assert [None if v is None else pytest.approx(v) for v in column] == table and all(v is None or len(v) == n for v in table)


def test_offsets_in_long_texts(spark):
    """Offsets equal str.find over parts of the search; and twice the text takes about twice the time."""
    rng = random.Random(3)
    rows = []
    for i in range(12):
        text = "".join(rng.choice("ab é漢😀\n") for _ in range(rng.choice([0, 5, 8191, 8192, 8193, 30_000])))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(8))
        pieces = [text[a : a + rng.choice([1, 40, 9000])] for a in cuts] + ["not there", ""]
        rows.append((i, text, pieces))
    made = spark.createDataFrame(rows, "i int, t string, c array<string>").select("i", chunking.with_offsets(F.col("t"), F.col("c")).alias("o")).collect()
    for r in made:
        _, text, pieces = rows[r["i"]]
        at = 0
        for k, (c, o) in enumerate(zip(pieces, r["o"], strict=True)):
            found = text.find(c, at) if at < len(text) else -1
            begin = found if found >= 0 else at
            assert (o["index"], o["start_char"], o["end_char"]) == (k, begin, begin + len(c))
            at = begin + 1

    def took(words):
        text = " ".join(f"w{i % 997}" for i in range(words))
        frame = spark.createDataFrame([(text,)], "t string").select(F.size(chunking.with_offsets(F.col("t"), chunking.forced(F.col("t"), 512))).alias("n"))
        begin = time.perf_counter()
        assert frame.first()["n"] == -(-len(text) // 512)
        return time.perf_counter() - begin

    took(5000)
    few = min(took(40_000) for _ in range(2))
    assert min(took(80_000) for _ in range(2)) < 2.5 * max(few, 0.4)


def test_likeness_without_vectors_is_that_of_vectors(spark):
    rows = [(["one stone", "two stones", "", None, "?!", "one stone", "one stone two"],), ([],), (None,), (["alone"],), (["?!", "word"],)]
    frame = spark.createDataFrame(rows, "t array<string>")
    provider = HashedTerms(32)
    got = frame.select(provider.alike(F.col("t")).alias("a"), neighbour_cosines(provider.embed_all(F.col("t"))).alias("b")).collect()
    for r in got:
        assert (r["a"] is None) == (r["b"] is None)
        assert [x if x is None else round(x, 12) for x in r["a"] or []] == [x if x is None else round(x, 12) for x in r["b"] or []]

"""Collocations and slack packing against brute force, and the arrays of words and ids that both need."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import collocations, slack_packing, token_ids, word_arrays, word_ids

ODD_TEXTS = ["", " ", "\t\n", ".", "a", "A b", "a.b", " a\tb  c ", "x" * 300, "é漢 😀\tÀ", "a\0b", "a\x0bb", "don't stop", ";;a;;b b b b"]


# -- words


def brute_words(texts, blanks=" \t", breaks=".,;:!?\n\x0b\x0c\r"):
    """(word, row, piece) with pieces numbered over all texts, empty ones left out."""
    out, number = [], 0
    for row, text in enumerate(texts):
        for piece in re.split("[" + re.escape(breaks) + "]", text) if breaks else [text]:
            words = [w for w in re.split("[" + re.escape(blanks) + "]+", piece) if w]
            out += [(w, row, number) for w in words]
            number += bool(words)
    return out


@pytest.mark.parametrize("step", [2_000_000, 40])
def test_words_of_texts(step):
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice(["a", "B", "cé", " ", "\t", ".", "\n", "!", "漢"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    classes, lower = word_arrays.byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r"), word_arrays.lower_ascii()
    held = texts if step > 1000 else [" . ".join(texts)]
    got, number, last = [], -1, None
    for part in word_arrays.words_of(pa.array(held, pa.string()), classes, lower, step):
        assert part.continued == (last is not None)
        base = number + (not part.continued)
        got += [(w.decode(), r, p + base) for w, r, p in zip(part.words.to_pylist(), part.row.tolist(), part.piece.tolist(), strict=True)]
        number, last = base + part.pieces - 1, part
    want = brute_words([re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in held])
    assert [(w, r) for w, r, _ in got] == [(w, r) for w, r, _ in want]
    ranks = {p: i for i, p in enumerate(sorted({p for *_, p in got}))}
    assert [ranks[p] for *_, p in got] == [p for *_, p in want]
    assert list(word_arrays.words_of(pa.array([], pa.string()), classes)) == []
    with pytest.raises(ValueError, match="ASCII"):
        word_arrays.byte_classes("é".encode())


def test_a_sliced_column_of_words():
    column = pa.array(["a b", "c d e", "f"], pa.string()).slice(1, 1)
    (part,) = word_arrays.words_of(column, word_arrays.byte_classes(b" "))
    assert part.words.to_pylist() == [b"c", b"d", b"e"] and part.row.tolist() == [0, 0, 0]


# -- collocations


def brute_collocations(rows, least, top, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for _, piece in itertools.groupby(brute_words([re.sub("[A-Z]", lambda m: m[0].lower(), text or "")]), key=lambda x: x[2]):
            words = [w for w, *_ in piece]
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {q[i : i + size] for q, c in candidates.items() for size in range(2, len(q)) for i in range(len(q) - size + 1) if f[q[i : i + size]] == c}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    common = ["the", "of", "new", "York", "city", "é漢", "in", "a"]
    fixed = ["new york city hall park", "as a matter of fact", "very very very very very very", "alpha beta"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            x = rng.random()
            parts.append(rng.choice(fixed) if x < 0.15 else rng.choice(common) if x < 0.7 else f"w{rng.randint(0, 60)}" if x < 0.9 else rng.choice([".", "\n", ", ", "\t", " !? "]))
        out.append((i, " ".join(parts), rng.choice(["en", "en", "de", None]), "s"))
    return out + [(500, None, "en", "s"), (501, "", None, "s"), (502, " .\n", "xx", "s"), (503, "lonely words", "xx", "s"), (504, "same same " * 30, "en", "s"), (504, "same same " * 30, "en", "s"), (None, "New York City hall park " * 20, "und", "s")]


@pytest.mark.parametrize("how", [{}, {"places": 90, "step": 7, "bucket": 300}, {"words": 3, "top": 5}])
def test_collocations_against_brute_force(spark, make, how):
    rows = phrase_rows(1)
    how = collocations.Phrases(least=6, **how)
    got = collocations.collocations(make(rows).repartition(3), how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, 6, how.top, how.words)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_a_long_text_is_counted_whole(spark, make, monkeypatch):
    monkeypatch.setattr(word_arrays.words_of, "__defaults__", (None, 500))
    text = " ".join(["over and over again"] * 300) + "." + " ".join(["b c"] * 200)
    rows = [(1, text, "en", "s"), (2, "and over", "en", "s")]
    frame = make(rows).coalesce(1)
    how = collocations.Phrases(least=3, places=64)
    assert sorted(map(tuple, collocations.collocations(frame, how).collect())) == brute_collocations(rows, 3, 2000)


def test_collocations_of_nothing(spark, make):
    assert collocations.collocations(make([])).count() == 0
    assert collocations.collocations(make([(1, None, "en", "s"), (2, "", None, None), (3, "few words", "en", "s")])).count() == 0


def test_scores_are_exact(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = rng.randint(100, 10 ** rng.randint(3, 12))
        rows.append((a, rng.randint(a, 10**14), a * rng.randint(1, 50) + rng.randint(0, 3), a + rng.randint(0, 10**6)))
    rows += [(10**12, 10**16, 10**12, 10**12), (10**12 - 1, 10**16 - 1, 10**12 + 1, 10**12 + 7)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = frame.select("*", collocations.exact_score("a", "n", "l", "r").alias("s")).collect()
    assert all(r["s"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in got)


def test_bitmaps_extend_by_shift_and_and():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 5, 400)
    gap = rng.random(400) < 0.1
    places = np.arange(400) + np.cumsum(gap)
    builder = collocations._Builder()
    builder.add(pa.array([f"{w}" for w in words]).cast(pa.binary()), np.cumsum(gap), int(gap.sum()))
    names, counts, blocks, at, bits = builder.bitmaps()
    steps = np.diff(at, prepend=0)
    first = np.cumsum(blocks) - blocks
    steps[first] = at[first]
    packed = collocations._packed(blocks.astype("<u4"), steps.astype("<u4"), bits.astype("<u2"))
    maps = collocations.Bitmaps(packed, np.arange(len(names)))
    node, word, n, *_ = collocations._children(*maps.extended(*collocations._of_words(maps, np.arange(len(names)))), len(names))
    got = {(names[int(a)].as_py(), names[int(b)].as_py()): int(c) for a, b, c in zip(node, word, n, strict=True)}
    want = Counter((str(words[i]).encode(), str(words[i + 1]).encode()) for i in range(399) if places[i + 1] == places[i] + 1)
    assert got == dict(want) and counts.sum() == 400 and len(at) < 400


def test_packed_arrays_come_back():
    for arrays in ([np.zeros(0, "<u4")], [np.arange(70_000, dtype="<u4"), np.array([1, 65535], "<u2"), np.array([2**63], "<u8")]):
        back = collocations._unpacked(collocations._packed(*arrays), *[a.dtype.str for a in arrays])
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


# -- token ids of words


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(word_ids.default_tokenizer())
    made.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, "<u4") for e in made.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_library(library, monkeypatch):
    rng = random.Random(1)
    bits = ["a", "B", "é", "é", "'s", "'", "S", "ß", "İ", "Σ", "ΑΣ", " ", "  ", "\t", "\n", "\r\n", "\x0b", " ", "\xa0", "1", "23", "!", "?!", "<|endoftext|>", "漢", "́", "x" * 300, "\0", "\x85", "don't", "😀", "‍"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ODD_TEXTS
    machine = word_ids.encoder(word_ids.default_tokenizer())
    assert isinstance(machine, word_ids.WordEncoder)
    want = [x.tobytes() for x in library(texts)]
    assert machine.encode(texts) == want and machine.encode([]) == []
    monkeypatch.setattr(word_ids, "MEMO", 50)
    monkeypatch.setattr(word_ids, "LONGEST", 3)
    assert word_ids.WordEncoder(word_ids.default_tokenizer()).encode(texts[:300]) == want[:300]


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(word_arrays.words_of, "__defaults__", (None, 100))
    texts = [" ".join(f"word{i % 50}" for i in range(2000)), "y" * 1000 + " é" * 500, "z" * 900]
    assert word_ids.WordEncoder(word_ids.default_tokenizer()).encode(texts[:1]) + word_ids.WordEncoder(word_ids.default_tokenizer()).encode(texts[1:]) == [x.tobytes() for x in library(texts)]


def test_other_files_are_not_taken_apart():
    assert isinstance(word_ids.encoder(token_ids.default_tokenizer()), token_ids.Encoder)
    base = {"normalizer": {"normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}}
    split = {"type": "Split", "pattern": {"Regex": r"[\p{L}]+|[^\s\p{L}]+"}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    good = base | {"pre_tokenizer": {"pretokenizers": [split, level]}}
    assert word_ids.drops_white_space(good)
    for pattern in (r"[\p{L}]+| ?x", r"\p{L}+(?=\s)", r"[^x]+"):
        assert not word_ids.drops_white_space(base | {"pre_tokenizer": {"pretokenizers": [split | {"pattern": {"Regex": pattern}}, level]}})
    assert not word_ids.drops_white_space(good | {"added_tokens": [{"content": "<x>", "lstrip": True}]})
    assert not word_ids.drops_white_space({})


# -- slack packing


def best_sum(lengths, room):
    return max((s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room), default=0)


def test_fill_comes_closest():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 90)
        left = slack_packing.Multiset(np.array(lengths, np.int64))
        taken = left.fill(room)
        assert sum(v * n for v, n in taken) == best_sum(lengths, room)
        there = Counter(lengths)
        assert all(n <= there[v] for v, n in taken)


def test_windows_take_the_longest_and_what_fills_it():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 300)
    windows = slack_packing.slack_windows(lengths, 100)
    assert Counter(v for w in windows for v, n in w for _ in range(n)) == Counter(lengths.tolist())
    assert all(sum(v * n for v, n in w) <= 100 for w in windows)
    left = Counter(lengths.tolist())
    for w in windows:
        assert w[0][0] == max(left)
        left -= Counter(dict(w))
    assert len(windows) <= 1.03 * lengths.sum() / 100 + 1
    assert slack_packing.slack_windows(np.zeros(0, np.int64), 100) == []


def placed_right(n, fillers, tokens):
    out = slack_packing.place(n, fillers, tokens)
    spans, windows = defaultdict(list), defaultdict(list)
    for doc, start, length, window, offset in out:
        assert length > 0
        spans[doc].append((start, length))
        windows[window].append((offset, length))
    for doc, size in enumerate(n.tolist()):
        parts = sorted(spans.get(doc, []))
        assert [s for s, _ in parts] == np.cumsum([0, *(x for _, x in parts[:-1])]).tolist()[: len(parts)] and sum(x for _, x in parts) == size
        assert fillers[doc] or len(parts) <= 1
    sums = []
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(x for _, x in parts[:-1])]).tolist()
        sums.append(sum(x for _, x in parts))
    assert max(sums, default=0) <= tokens
    return sum(tokens - s for s in sums if s & (s - 1))


@pytest.mark.parametrize("size", [0, 1, 2, 7, 60, 3000])
def test_places(size):
    rng = np.random.default_rng(size)
    for share in (0.0, 0.1, 1.0):
        n = np.minimum(2047, rng.geometric(1 / 400, size)) * (rng.random(size) > 0.05)
        fillers = rng.random(size) < share
        padding = placed_right(n.astype(np.int64), fillers, 2048)
        if share == 1.0 or share and size == 3000:
            assert padding == 0
    assert slack_packing.powers_of_two(1000) == [512, 256, 128, 64, 32, 8]


def test_slack_packing(spark, make, words, library):
    odd = [(None, "a text without an id", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, " \n\t ", "en", "s2"), (4, "12 34 !!", "fr", None), (5, "same words here", "en", "s1"), (5, "same words here", "en", "s1")]
    rows = [*odd, *((100 + i, words(random.Random(i).randint(1, 1500), i), "en", "s") for i in range(80)), (900, words(9000, 9), "en", "s"), (901, words(2047, 3), "en", "s")]
    ids = defaultdict(list)
    for r, x in zip(rows, library([r[1] or "" for r in rows]), strict=True):
        ids[r[0]].append(np.append(x, np.uint32(1)).astype("<u4"))
    for how in (slack_packing.Windows(), slack_packing.Windows(group=9, filler=2), slack_packing.Windows(tokens=512, filler=1)):
        packed = slack_packing.pack_documents(make(rows).repartition(3), word_ids.default_tokenizer(), how)
        got = packed.collect()
        sequences, documents = defaultdict(list), defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            documents[r["doc_id"], r["row"]].append((r["start"], r["length"]))
            own = ids[r["doc_id"]][0]
            assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert len(documents) == len(rows)
        for (doc, _), parts in documents.items():
            parts.sort()
            assert [s for s, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) == len(ids[doc][0])
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= how.tokens
        total = sum(len(x) for v in ids.values() for x in v)
        padding = sum(how.tokens - s for parts in sequences.values() if (s := sum(n for _, n in parts)) & (s - 1))
        assert padding <= 0.03 * total if how.group > 9 else True
        assert sorted(map(str, got)) == sorted(map(str, packed.collect()))
        if how.filler == 1:
            assert padding == 0
    assert slack_packing.pack_documents(make([]), word_ids.default_tokenizer()).count() == 0


def test_slack_packing_of_documents(spark):
    """On the given table: whole cover, no overfull sequence, next to no padding."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = slack_packing.pack_documents(docs, word_ids.default_tokenizer())
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.col("offset")).alias("o"))
    row = per.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("n").bitwiseAND(F.col("n") - 1) != 0, 2048 - F.col("n")).otherwise(0)).alias("padding")).first()
    whole = packed.groupBy("doc_id", "row").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert row["most"] <= 2048 and row["padding"] <= 0.02 * row["n"] and whole.where("n <> t").isEmpty() and whole.count() == docs.count()

"""Operators on documents against brute force: secrets, languages, packing, token files, near-duplicates, counts, mixing."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import entropy_mixing, hamming_minhash, hd_language, orc_tokens, secret_dfa, vector_packing, viterbi_count
from foliant.llm.common import new_path
from foliant.llm.token_ids import Encoder, default_tokenizer, encoder

ODD = [(None, "a text without an id", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, " \n\t ", "en", "s2"), (4, "12 34 !!", "fr", None), (5, "same words here", "en", "s1"), (5, "same words here", "en", "s1"), (6, "x" * 300_000, "en", "s3")]


# -- secrets

PYTHON_RULES = [
    (re.compile(rb"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"), 8),
    (re.compile(rb"()(AKIA[A-Z0-9]+)"), 16),
    (re.compile(rb"()([0-9a-f]+)"), 32),
    (re.compile(rb"()(gh[pousr]_[A-Za-z0-9]+)"), 40),
    (re.compile(rb"()(xox[abprs]-[A-Za-z0-9-]+)"), 20),
    (re.compile(rb"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)"), 1),
]


def brute_spans(data):
    return sorted((m.start(), k, m.end()) for k, (p, n) in enumerate(PYTHON_RULES) for m in p.finditer(data) if len(m[2]) >= n)


def test_automaton_against_regular_expressions():
    random.seed(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIkey", '"', "'", " ", ":", "=", "abc123", "deadbeef" * 5, "AKIA", "AK", "ABCDEFGH12345678", "é", "漢", "xoxb-", "ghp_", "a" * 40, "-----BEGIN ", "PRIVATE KEY-----", "_", "\n", "tok", "K", "ſ"]
    machine = secret_dfa.automaton(secret_dfa.DEFAULT_RULES)
    for _ in range(4000):
        data = "".join(random.choice(bits) for _ in range(random.randint(0, 14))).encode()
        assert machine.spans(data) == brute_spans(data)


def test_rules_that_look_back_are_refused():
    with pytest.raises(ValueError, match="look back"):
        secret_dfa.Automaton((secret_dfa.Rule("r", "", "ab(cd)*", 1),))
    with pytest.raises(ValueError, match="empty"):
        secret_dfa.Automaton((secret_dfa.Rule("r", "", "a*", 1),))


def test_minimisation_keeps_the_language():
    rules = (secret_dfa.Rule("r", "", "a{2,3}b|xyz", 1),)
    got = secret_dfa.Automaton(rules)
    for text in (b"aab", b"aaab", b"aaaab", b"ab", b"xyxyz", b"aabxyz"):
        assert [(b, e) for b, _, e in got.spans(text)] == [m.span() for m in re.finditer(rb"a{2,3}b|xyz", text)]


def test_secret_spans_and_redaction(spark, make):
    rows = [*ODD, (7, "é token = abcdefgh12 end", "en", "s"), (8, "secret=" + "0123456789abcdef" * 2, "en", "s")]
    got = {(r["doc_id"], tuple(tuple(s) for s in r["secrets"])) for r in secret_dfa.scan_secrets(make(rows)).collect()}
    assert (7, (("assign", 2, 20),)) in got
    assert (8, (("assign", 0, 39), ("hex", 7, 39))) in got
    assert (1, ()) in got and (None, ()) in got and len(secret_dfa.scan_secrets(make(rows)).collect()) == len(rows)
    clean = {r["doc_id"]: r["t"] for r in make(rows).select("doc_id", secret_dfa.redacted(F.col("text")).alias("t")).collect()}
    assert clean[7] == "é [assign] end" and clean[8] == "[assign]" and clean[1] is None
    assert secret_dfa.scan_secrets(make([])).count() == 0


# -- languages


def test_languages(spark, make, words):
    texts = {"en": "the house and the river with that ", "de": "das haus und der fluss mit dem ", "fr": "la maison et le fleuve avec cette "}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample(texts[lang].split() * 3, 15)), lang, "s") for i, lang in enumerate(rng.choices(list(texts), k=240))]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 3 -- !", "en", "s"), (None, "das haus", "de", "s"), (903, "maison " * 300_000, None, "s"), (904, "漢字" * 50, None, "s")]
    got = {r["doc_id"]: r for r in hd_language.identify(make(rows)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} >= {r[0] for r in held}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.95
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[903]["lang_pred"] == "fr" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert hd_language.identify(make([])).count() == 0
    assert {r["lang_pred"] for r in hd_language.identify(make([(1, "abc", None, "s")])).collect()} == {"und"}


def test_profiles_equal_the_definition():
    space = hd_language.Space(dimensions=64)
    profiler = hd_language.Profiler(space)
    text = "Ab, c! ABC é1d"
    symbols = [0]
    for c in text.lower():
        if c.isalpha():
            symbols.append(ord(c))
        elif symbols[-1]:
            symbols.append(0)
    symbols += [0] if symbols[-1] else []
    total = np.zeros(64)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        total += np.roll(profiler.letter(a), 2) * np.roll(profiler.letter(b), 1) * profiler.letter(c)
    assert np.allclose(profiler.profiles([text])[0][0], total)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_profiles_do_not_depend_on_the_step(step, monkeypatch):
    space = hd_language.Space(dimensions=64)
    rng = random.Random(step)
    texts = ["".join(rng.choice("aBcé ,.1 İΣ漢\n  ") for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["", " ", "a", "Σ", "abc, " * 90]
    profiles, letters = hd_language.Profiler(space).profiles(texts)
    bundled = hd_language.Profiler(space).bundle(texts, np.arange(len(texts)) % 3, 3)
    monkeypatch.setattr(hd_language, "STEP_POINTS", step)
    monkeypatch.setattr(hd_language, "STEP_COUNTS", 50)
    again, letters_again = hd_language.Profiler(space).profiles(texts)
    assert np.array_equal(letters, letters_again)
    assert np.allclose(profiles, again) and np.allclose(bundled, hd_language.Profiler(space).bundle(texts, np.arange(len(texts)) % 3, 3), atol=1e-5)


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = hd_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in both]) >= 0.98


# -- tokens


def test_pre_tokens_with_equal_hashes(monkeypatch):
    """Polynomial hashes modulo a power of two cannot tell a long Thue-Morse word from its complement."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    machine = Encoder(default_tokenizer())
    for texts in ([word, other], [other], ["x " + other + " y", word], ["plain text", word + " " + other]):
        assert machine.encode(texts) == [x.tobytes() for x in library_ids(texts)]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library():
    random.seed(2)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "Foo", "'s", "'", "'ll", "n't", "123", " 4", "é", "漢字", "\xa0", "!?", "😀", "\r\n", "_", "<|endoftext|>", "x" * 70, "\x00", "\u0301", chr(0xE000), chr(0x10FFFF)]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(5000)] + ["", " ", "it's we'll ''s"]
    expected = [x.tobytes() for x in library_ids(texts)]
    machine = encoder(default_tokenizer())
    assert machine.encode(texts) == expected
    import foliant.llm.token_ids as module

    before, module.STEP = module.STEP, 30
    try:
        assert machine.encode(texts) == expected
    finally:
        module.STEP = before


def test_token_files(spark, make):
    rows = [*ODD, (-7, "first of all", "en", "s"), (10**12, "last of all <|endoftext|>", "en", "s")]
    path = new_path(spark, "tokens")
    orc_tokens.write_tokens(make(rows).repartition(3), path, default_tokenizer(), partitions=3)
    got = orc_tokens.digests(spark, path).collect()
    ids = {r[1]: np.append(x, np.uint32(0)) for r, x in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True)}
    expected, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        expected.append((doc, start, len(ids[text]), zlib.crc32(ids[text].tobytes())))
        start += len(ids[text])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    one = orc_tokens.read_tokens(spark, path).where("doc_id = -7").collect()
    assert [r["ids"] for r in one] == [ids["first of all"].tolist()]
    plan = orc_tokens.read_tokens(spark, path).where("doc_id = -7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,-7)" in plan
    empty = new_path(spark, "tokens")
    orc_tokens.write_tokens(make([]), empty, default_tokenizer(), partitions=2)
    assert orc_tokens.digests(spark, empty).count() == 0


def test_token_files_skip_what_is_not_asked(spark, make):
    rows = [(i, f"text {i}", "en", "s") for i in range(0, 12_000, 2)]
    path = new_path(spark, "tokens")
    orc_tokens.write_tokens(make(rows), path, default_tokenizer(), partitions=2)

    def read(condition):
        found = orc_tokens.read_tokens(spark, path).where(condition)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            query = found._jdf.queryExecution()
            n = query.executedPlan().executeCollectPublic()
            leaves = query.executedPlan().collectLeaves()
            return len(n), leaves.apply(0).metrics().apply("numOutputRows").value()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    # Row groups hold 1000 rows: minima and maxima skip all but one, and the Bloom filter that one too.
    assert read("doc_id = 5000")[0] == 1 and read("doc_id = 5000")[1] <= 1000
    assert read("doc_id = 5001") == (0, 0)
    assert read("doc_id > 50000") == (0, 0)


def test_token_files_split_one_id(spark, make, words):
    rows = [(None, words(30, i % 50), "en", "s") for i in range(400)] + [(i, words(5, i), "en", "s") for i in range(30)]
    path = new_path(spark, "tokens")
    orc_tokens.write_tokens(make(rows).repartition(4), path, default_tokenizer(), partitions=4)
    sizes = [r["n"] for r in orc_tokens.read_tokens(spark, path).where("doc_id is null").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 250
    got = sorted(orc_tokens.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == [None] * 400 + list(range(30))


def test_packing(spark, make, words):
    rows = [*ODD[:7], *((100 + i, words(random.Random(i).randint(1, 2500), i), "en", "s") for i in range(60))]
    packed = vector_packing.pack_documents(make(rows), default_tokenizer()).collect()
    ids = defaultdict(list)
    for r, x in zip(rows, library_ids([r[1] or "" for r in rows]), strict=True):
        ids[r[0]].append(np.append(x, np.uint32(0)))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["row"]].append((r["piece"], r["start"], r["length"]))
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.astype("<u4").tobytes()) == r["ids_crc32"]
    assert len(pieces) == len(rows)
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == np.cumsum([0, *(n for _, n in placed[:-1])]).tolist() and sum(n for _, n in placed) <= 2048
    for (doc, _), cut in pieces.items():
        cut.sort()
        assert sum(n for *_, n in cut) == len(ids[doc][0]) and all(n == 2048 for *_, n in cut[1:])
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(sequences) <= -(-total // 2048) + 2
    assert vector_packing.pack_documents(make([]), default_tokenizer()).count() == 0


def test_documents_of_many_pieces_and_repeats(spark, make, words):
    book = words(6000, 3)
    rows = [(1, book, "en", "s")] * 4 + [(2, words(5, 1), "en", "s")] * 40 + [(None, book[:20000], "en", "s")]
    frame = make(rows).repartition(2)
    packed = vector_packing.pack_documents(frame, default_tokenizer(), vector_packing.Capacity(group=3)).collect()
    pieces = defaultdict(list)
    for r in packed:
        pieces[r["row"]].append((r["piece"], r["start"], r["length"]))
    assert len(pieces) == len(rows)
    for cut in pieces.values():
        cut.sort()
        assert [p for p, *_ in cut] == list(range(len(cut))) and cut[0][1] == 0
        assert all(s + n == t for (_, s, n), (_, t, _) in zip(cut, cut[1:])) and all(n == 2048 for *_, n in cut[1:])
    full = [r["sequence_id"] for r in packed if r["length"] == 2048]
    held = defaultdict(int)
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert len(set(full)) == len(full) and all(held[s] == 2048 for s in full) and max(held.values()) <= 2048
    few = vector_packing.pack_documents(frame, default_tokenizer(), vector_packing.Capacity(documents=3)).collect()
    counts = defaultdict(int)
    for r in few:
        counts[r["sequence_id"]] += 1
    assert max(counts.values()) == 3 and len(few) == len(packed)


def test_cuts_are_the_same_in_any_order(spark, make, words):
    rows = [(1, words(9, 1), "en", "s")] * 3 + [(2, words(9, 1), "en", "s"), (None, None, "en", "s"), (3, words(3000, 2), "en", "s")]
    cut = lambda rows: sorted(map(str, vector_packing.cut_documents(make(rows).coalesce(1), default_tokenizer()).collect()))
    assert cut(rows) == cut(rows[::-1]) and len(set(cut(rows))) == len(rows)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.random.default_rng(3).integers(1, 60, 500)
    capacity = vector_packing.Capacity(tokens=100, documents=4, attention=4000, score=score)
    bins, offsets = vector_packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == sorted(offsets[bins == b]) and offsets[bins == b].max() + own[offsets[bins == b].argmax()] == own.sum()
    with pytest.raises(ValueError):
        vector_packing.best_fit(np.array([99]), capacity)
    assert len(vector_packing.best_fit(np.zeros(0, np.int64), capacity)[0]) == 0


def test_other_capacities_bind_only_below_the_contract():
    lengths = np.random.default_rng(4).integers(1, 1500, 300)
    usual = vector_packing.best_fit(lengths, vector_packing.Capacity())[0]
    few = vector_packing.best_fit(lengths, vector_packing.Capacity(documents=2))[0]
    cheap = vector_packing.best_fit(lengths, vector_packing.Capacity(attention=1500 * 1500))[0]
    squares = lambda bins: max((lengths[bins == b] ** 2).sum() for b in np.unique(bins))
    assert np.bincount(usual).max() > 2 == np.bincount(few).max()
    assert squares(usual) > 1500 * 1500 >= squares(cheap)
    assert max(lengths[usual == b].sum() for b in np.unique(usual)) <= 2048


# -- near-duplicates


def sets_of(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1)))


def brute_components(rows, k, per_hundred):
    sets = [sets_of(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_hundred * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return sets, [find(i) for i in range(len(rows))]


def family(words, size, n, changes, seed):
    """Copies of one text with some words replaced."""
    base = words(size, seed).split()
    out = []
    for i in range(n):
        rng, copy = random.Random(seed * 1000 + i), list(base)
        for at in rng.sample(range(size), rng.randint(0, changes)):
            copy[at] = f"new{rng.random()}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("k", "per_hundred"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, make, words, k, per_hundred):
    texts = [*family(words, 120, 40, 9, 1), *family(words, 60, 25, 3, 2), *family(words, 300, 20, 14, 3), *(words(80, 100 + i) for i in range(30))]
    texts += ["Two Words", "two words", "one", "ONE", "\x0bone\x0c", "É é", "é É", None, "", "  "]
    rows = [(1000 - i, t, "en", "s") for i, t in enumerate(texts)]
    how = hamming_minhash.NearDuplicates(words=k, per_hundred=per_hundred, block=7)
    got = {r["doc_id"]: r for r in hamming_minhash.near_duplicates(make(rows), how).collect()}
    sets, roots = brute_components(rows, k, per_hundred)
    least = defaultdict(lambda: 10**9)
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least[root], r[0])
    for r, s, root in zip(rows, sets, roots, strict=True):
        assert got[r[0]]["n_shingles"] == len(s)
        assert got[r[0]]["component_id"] == least[root], r


def test_signature_keys_guarantee():
    how = hamming_minhash.NearDuplicates(words=3, per_hundred=85)
    signer, rng = hamming_minhash.Signer(how), np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (300, how.symbols)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(how.symbols, rng.integers(0, how.distance + 1), replace=False)
        row[at] ^= 1
    (x, slots), (y, _) = signer.keys(a), signer.keys(b)
    same = x == y
    assert same.any(axis=1).all()
    assert (slots[same.argmax(axis=1)] == signer.first_slots(a != b)).all()
    assert (signer.first_slots(np.ones((1, how.symbols), bool)) == -1).all()


def test_signature_distance_follows_similarity():
    how = hamming_minhash.NearDuplicates(words=3, per_hundred=85)
    signer, rng = hamming_minhash.Signer(how), np.random.default_rng(6)
    gaps = []
    for _ in range(300):
        u = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        gaps.append(int((signer.sign(np.sort(u[:925])) != signer.sign(np.sort(u[75:]))).sum()))
    assert abs(np.mean(gaps) / how.symbols - 0.15) < 0.01 and max(gaps) <= how.distance


def test_null_ids_take_no_longer(spark, make, words):
    """Rows without an id are told apart by their texts; none is shingled for another."""
    texts = [*family(words, 80, 20, 2, 7), *(words(40, 300 + i) for i in range(60))]
    rows = [(None, t, "en", "s") for t in texts] + [(None, texts[0], "en", "s")] * 5 + [(7, texts[25], "en", "s"), (9, texts[0], "en", "s")]
    got = hamming_minhash.near_duplicates(make(rows)).collect()
    sets, roots = brute_components(rows, 5, 80)
    groups, own = defaultdict(set), defaultdict(set)
    for r, root in zip(rows, roots, strict=True):
        groups[root].add(hash(r[1]))
    ids = defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            ids[root].append(r[0])
    named = sorted(min(ids[root]) for root in roots if ids[root])
    assert sorted(r["component_id"] for r in got if r["component_id"] is not None) == named and len(got) == len(rows)


def test_sets_that_share_a_hash_are_told_apart(spark, make, words, monkeypatch):
    before = hamming_minhash._node
    monkeypatch.setattr(hamming_minhash, "_node", lambda s, seed: 5 if seed == 0 else before(s, seed))
    rows = [(1, words(30, 1), "en", "s"), (2, words(30, 2), "en", "s"), (3, words(30, 1), "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in hamming_minhash.near_duplicates(make(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_keep_one(spark, make, words):
    text = words(50, 1)
    rows = [*ODD, (20, text, "en", "s"), (21, text, "en", "s"), (19, text + " more", "en", "t"), (22, words(50, 2), "en", "s"), (None, text, "en", "s")]
    kept = hamming_minhash.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == sorted([(False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (True, 6), (True, 19), (True, 22)])
    assert hamming_minhash.keep_one(make([])).count() == 0


# -- counts


def test_counts_equal_the_library(spark, make):
    from tokenizers import Tokenizer, models, pre_tokenizers

    random.seed(3)
    for _ in range(60):
        pieces = list({"".join(random.choice("ab▁c") for _ in range(random.randint(1, 3))) for _ in range(random.randint(2, 9))})
        vocabulary = [("<unk>", 0.0), *((p, -float(random.randint(1, 4))) for p in pieces)]
        library = Tokenizer(models.Unigram(vocabulary, 0, False))
        library.pre_tokenizer = pre_tokenizers.Metaspace()
        own = viterbi_count.Counter(viterbi_count.Vocabulary(tuple(vocabulary), 0))
        for _ in range(20):
            text = "".join(random.choice("abcd ▁") for _ in range(random.randint(0, 12)))
            assert own.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids)


def library_unigram(vocabulary):
    """The library's model of the same table, spaces written and one put before the text as the file has it."""
    from tokenizers import Tokenizer, models, normalizers

    special = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    library = Tokenizer(models.Unigram([*special, *vocabulary.pieces], 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(library.encode(text, add_special_tokens=False).ids) if text else 0


def test_counts_of_the_file_equal_the_library(spark, make):
    vocabulary = viterbi_count.read_vocabulary(viterbi_count.default_vocabulary())
    names = [p for p, _ in vocabulary.pieces]
    assert len(names) == 32_000 - 259 and vocabulary.byte_pieces and not {"<s>", "</s>", "<unk>", "<0x0A>"} & set(names)
    library = library_unigram(vocabulary)
    odd = [(20, "the  house and  rivers", "en", "s"), (21, "unbelievable things", "en", "s"), (22, "  x   ", "en", "s"), (23, "ab\ncd\x00 漢字😀𐍈 ▁▁a", "en", "s"), (24, " ", "en", "s")]
    rows = ODD + odd
    got = viterbi_count.count_tokens(make(rows), viterbi_count.default_vocabulary()).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(str, ((r[0], library(r[1])) for r in rows)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = viterbi_count.count_tokens(docs, viterbi_count.default_vocabulary()).join(docs, "doc_id").collect()
    assert all(r["n_tokens"] == library(r["text"]) for r in found) and len(found) == 1000
    assert viterbi_count.count_tokens(make([]), viterbi_count.default_vocabulary()).count() == 0


def test_special_pieces_are_not_matched():
    machine = viterbi_count.counter(viterbi_count.default_vocabulary())
    pieces = dict(machine.vocabulary.pieces)

    def brute(text):
        """Tokens of the best path, by trying all pieces at all places."""
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - 16), end):
                if text[begin:end] in pieces:
                    total = best[begin][0] + pieces[text[begin:end]]
                    if best[end] is None or total > best[end][0]:
                        best[end] = (total, best[begin][1] + 1)
            if text[end - 1] not in pieces and (best[end] is None or best[end - 1][0] + machine.unknown > best[end][0]):
                best[end] = (best[end - 1][0] + machine.unknown, best[end - 1][1] + len(text[end - 1].encode()))
        return best[-1][1]

    for text in ("a<s>b", "<0x41><0x42>", "<unk>", "</s> x", "\n\n a", "é̈ 漢"):
        assert machine.text(text)[0] == brute(text), text
    assert machine.text("a<s>b")[0] >= 4


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_whole_texts_of_odd_vocabularies(byte_pieces):
    """Pieces with spaces inside, and vocabularies without a piece for the space."""
    from tokenizers import Tokenizer, models, normalizers

    random.seed(15)
    for _ in range(80):
        pieces = list({"".join(random.choice("ab▁") for _ in range(random.randint(1, 4))) for _ in range(random.randint(2, 9))})
        scored = tuple((p, -float(random.randint(1, 4))) for p in pieces)
        special = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256) if byte_pieces)]
        library = Tokenizer(models.Unigram([*special, *scored], 0, byte_pieces))
        library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        own = viterbi_count.Counter(viterbi_count.Vocabulary(scored, byte_pieces=byte_pieces, whole=True))
        for _ in range(20):
            text = "".join(random.choice("abcé ") for _ in range(random.randint(1, 12)))
            assert own.text(text)[0] == len(library.encode(text, add_special_tokens=False).ids), (scored, text)


# -- mixing


def spec_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over


def test_mixing(spark, make, words):
    rng = random.Random(8)
    shares = ["big"] * 300 + ["Small"] * 4 + ["mid"] * 60 + [None] * 40 + ["é"] * 30
    rows = [(i, words(rng.randint(1, 120), i), "en", s) for i, s in enumerate(shares)] + [(990, None, "en", "big"), (991, "", "en", "empty"), (None, "a b c", "en", "mid"), (992, "a b", "en", "mid"), (992, "a b", "en", "mid")]
    got = entropy_mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["_mix_size"] == len((r["text"] or "").split())
        assert 0 <= r["_mix_copies"] <= 3
        sizes[r["source"]] += r["_mix_size"]
        taken[r["source"]] += r["_mix_size"] * r["_mix_copies"]
        target[r["source"]] = r["_mix_target"]
    expected = spec_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])
    again = entropy_mixing.mix(make(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert entropy_mixing.mix(make([])).count() == 0


def test_prior_rates_are_tilted(spark, make, words):
    rows = [(i, words(20, i), "en", "ab"[i % 2]) for i in range(200)]
    docs = make(rows).withColumn("q", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(4.0))
    got = entropy_mixing.mix(docs, weights=(3, 1), prior="q").collect()
    for s, share in (("a", 0.75), ("b", 0.25)):
        own = [r for r in got if r["source"] == s]
        assert sum(r["_mix_rate"] * r["_mix_size"] for r in own) == pytest.approx(share * 4000, rel=1e-6)
        low, high = ({r["_mix_rate"] for r in own if r["q"] == q} for q in (1.0, 4.0))
        assert max(high) == pytest.approx(min(3, 4 * max(low)))


def test_rates_are_tilted_by_size(spark, make, words):
    rng = random.Random(14)
    rows = [(i, words(rng.choice([5, 10, 20, 40, 80]), i), "en", "ab"[i % 2]) for i in range(400)]
    got = entropy_mixing.mix(make(rows), weights=(1, 3)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert sum(r["_mix_rate"] * r["_mix_size"] for r in own) == pytest.approx(own[0]["_mix_target"], rel=1e-6)
        # The logarithm of the rate is proportional to the size, below the cap.
        tilts = {round(np.log(r["_mix_rate"]) / r["_mix_size"], 9) for r in own if r["_mix_rate"] < 3}
        assert len(tilts) == 1 and (min(tilts) < 0) == (s == "a")
        assert len({r["_mix_rate"] for r in own}) > 2


def test_balance_is_the_least_relative_entropy(spark):
    sizes = [3, 7, 7, 20, 45]
    docs = spark.createDataFrame([("s", n, 1.0) for n in sizes], "source string, size long, prior double")
    target = 0.6 * sum(sizes)
    found = entropy_mixing.balance(docs, spark.createDataFrame([("s", target), ("none", 0.0)], "source string, target double"))
    dual, mean = {r["source"]: (r["dual"], r["mean"]) for r in found.collect()}["s"]
    rates = [np.exp(dual * n / mean) for n in sizes]
    cost = lambda r: sum(x * np.log(x) - x + 1 for x in r)
    assert np.dot(sizes, rates) == pytest.approx(target)
    rng = np.random.default_rng(3)
    for _ in range(200):
        other = np.clip(rates + rng.normal(size=5) * 0.05, 1e-6, 3)
        other *= target / np.dot(sizes, other)
        assert cost(other) >= cost(rates) - 1e-12


def test_repeated_rows_are_rounded_apart(spark, make, words):
    rows = [(1, words(10, 1), "en", "a")] * 300 + [(None, words(7, 2), "en", "b")] * 150 + [(i, words(12, i), "en", "c") for i in range(100, 300)]
    got = entropy_mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["_mix_size"] * r["_mix_copies"]
        target[r["source"]] = r["_mix_target"]
    for s in "abc":
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], s
    again = entropy_mixing.mix(make(rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_uses_no_python(spark, make):
    rows = [(1, "a b c", "en", "a")] * 3 + [(2, "d e", "en", "b")]
    plan = entropy_mixing.mix(make(rows)).select("_mix_copies")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- the pipeline


def test_pipeline_stages(spark, make, words, tmp_path):
    english = "the house and the river with that there other which "
    rows = [(i, english * 3 + words(60, i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " extra", "en", "s1"), (202, "password = hunter2hunter2 " + words(40, 9), "en", "s2"), (203, None, "en", "s0"), (204, "123 456", None, "s1"), (205, words(40, 10), None, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: sorted(r["doc_id"] for r in sizes[name].select("doc_id").collect())
    assert ids("language_id") == sorted(r[0] for r in rows if r[0] not in (203, 204))
    assert ids("near_duplicates") == [i for i in ids("language_id") if i not in (200, 201)]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in sizes["secrets"].collect()}
    assert text[202][0].startswith("[assign] ") and text[202][1] == len(text[202][0]) and text[0][0] == rows[0][1]
    assert set(ids("source_mix")) <= set(ids("secrets"))
    assert sum(r["length"] for r in sizes["packing"].collect()) == sum(len(x) + 1 for x in library_ids([r["text"] for r in sizes["source_mix"].collect()]))
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in sizes["packing"].collect())


def test_language_stage_rejects_what_is_not_learned(spark, make):
    said = {
        "en": "the house and the river with that there other which water was very old and they went into it ",
        "de": "das Haus und der Fluss mit dem alten Wasser ist nicht sehr weit und sie gehen auch dorthin ",
        "fr": "la maison avec la rivière et une eau très vieille dans les champs où ils sont allés ",
        "es": "la casa con el río y el agua muy vieja en los campos por donde ellos pasaron ayer ",
    }
    rows = [(i, text * 3, lang, "s") for k, (lang, text) in enumerate(said.items()) for i in range(20 * k, 20 * k + 20)]
    short = [(100 + i, text, None, "s") for i, text in enumerate(["the", "Avec.", "und", "el agua", "house"])]
    rng = random.Random(13)
    scripts = [range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x5D0, 0x5EB), range(0x4E00, 0x5E00)]
    other = [(200 + i, " ".join("".join(chr(rng.choice(scripts[i % 4])) for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([1, 5, 80]))), None, "s") for i in range(120)]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    got = {r["doc_id"] for r in stage(spark, make(rows + short + other), "").select("doc_id").collect()}
    assert got == {r[0] for r in rows + short}


def test_language_stage_rejects_words_over_and_over(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    gone = docs.join(stage(spark, docs, "").select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id", "left").collect()
    assert 0 < len(gone) < 60
    assert all(r["quality"] in (0, None) for r in gone)
    for r in gone:
        found = r["text"].split()
        assert len(set(found)) < 0.5 * len(found)


def test_pipeline_stages_on_nothing(spark, make):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]), "").count() == 0, name

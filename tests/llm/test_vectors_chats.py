"""Embedding near-duplicates, exact top-k, and chat formatting against brute force."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat_format, components, flat_graph, histogram_topk


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return frame.selectExpr("*", "vec_id as rep", "'c' as cell", "1 as copies", "2 as low")


def blobs(n, seed, dim=16):
    """Random unit vectors with some tight groups."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for begin, size in ((0, n // 5), (n // 2, 12)):
        x[begin : begin + size] = x[begin] + 0.03 * rng.normal(size=(size, dim)) * np.linalg.norm(x[begin])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [], 1), (906, [1.0, 2.0], 1)]


def brute_links(rows):
    data = {i: (label, np.array(v, np.float64)) for i, v, label in rows if i is not None and i < 900 and label is not None}
    links = defaultdict(set)
    for a, (la, x) in data.items():
        for b, (lb, y) in data.items():
            if a != b and la == lb and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    return links


@pytest.mark.parametrize("shard", [8192, 60])
def test_near_vectors(spark, shard):
    x = blobs(240, 1)
    rows = [(i, x[i].tolist(), i % 2 if i >= 48 else 0) for i in range(240)] + [(300 + i, x[i].tolist(), 0) for i in range(5)] + [(400, x[0].tolist(), None)] + BAD
    found, recall = flat_graph.near_vectors(vectors(spark, rows), flat_graph.FlatGraph(shard=shard))
    got = {r["vec_id"]: r for r in found.collect()}
    links = brute_links(rows)
    assert len(got) == len(rows) and recall >= 0.95
    true = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * true
    assert all(got[i]["n_links"] <= len(links[i]) for i in got)
    if shard == 8192:
        assert all(got[i]["n_links"] == len(links[i]) for i in got)
        seen = {}
        for i in sorted(got):
            todo = [i] if i not in seen else []
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen[j] = i
                    todo += links[j]
        assert {i: r["component_id"] for i, r in got.items()} == seen
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i, *_ in BAD)


def circle(n):
    """Vectors around a circle, each within the similarity of many on both sides."""
    at = np.random.default_rng(5).permutation(n) * 2 * np.pi / n
    return np.stack([np.cos(at), np.sin(at)], axis=1)


def test_shards_overlap_at_every_level(spark):
    x = circle(720)
    rows = [(i, "a", 2, x[i].tolist(), 1) for i in range(720)]
    how = flat_graph.FlatGraph(shard=120, branches=4)
    cells = defaultdict(set)
    for r in flat_graph.shards(spark.createDataFrame(rows, "rep long, label string, dim int, embedding array<double>, copies long"), how).collect():
        cells[r["rep"]].add(r["cell"])
    assert max(c.count("/") for of in cells.values() for c in of) > 1
    assert max(Counter(c for of in cells.values() for c in of).values()) <= 120
    near = np.argwhere(x @ x.T >= 0.98)
    assert all(cells[a] & cells[b] for a, b in near.tolist())
    found, _ = flat_graph.near_vectors(vectors(spark, [(i, x[i].tolist(), 1) for i in range(720)]), how)
    assert {r["component_id"] for r in found.collect()} == {0}


def test_labels_below_the_target_are_compared_in_full(spark):
    x = circle(720)
    rows = [(i, x[i].tolist(), 1) for i in range(720)] + [(800, x[0].tolist(), 1), (801, [1.0, 0.0], 2), (802, [1.0, 0.01], 2)]
    found, recall = flat_graph.near_vectors(vectors(spark, rows), flat_graph.FlatGraph(shard=120, branches=3, overlap=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    data = np.vstack([x, x[:1]]).astype(np.float32).astype(np.float64)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    true = (data @ data.T >= 0.98).sum(axis=1) - 1
    assert got == {**{i if i < 720 else 800: (n, 0) for i, n in enumerate(true.tolist())}, 801: (1, 801), 802: (1, 801)}
    assert recall >= 0.95


def test_audit_draws_until_it_holds_links(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(640, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:60] + rng.normal(size=(60, 8)) * 0.055
    tight = [1.0] + [0.0] * 7 + 0.01 * rng.normal(size=(80, 8))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([x, near]))] + [(700 + i, v.tolist(), 2) for i, v in enumerate(tight)]
    how = flat_graph.FlatGraph(shard=120, overlap=1, audited=4)
    found, recall = flat_graph.near_vectors(vectors(spark, rows), how)
    links = brute_links([(i, np.float32(v), label) for i, v, label in rows])
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == {i: len(links[i]) for i, *_ in rows}
    assert recall >= 0.95


def test_the_search_crosses_shards(spark):
    """One broad blob whose shards cut through dense places: the united graph leads the searches on, without the comparison in full."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=16)
    x = x / np.linalg.norm(x) + rng.normal(size=(1200, 16)) * 0.045
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data = np.float32(x).astype(np.float64)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    links = data @ data.T >= 0.98
    np.fill_diagonal(links, False)
    how = flat_graph.FlatGraph(shard=150, recall=0.0)
    got = {r["vec_id"]: r for r in flat_graph.near_vectors(vectors(spark, rows), how)[0].collect()}
    n = np.array([got[i]["n_links"] for i in range(1200)])
    assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.95 * links.sum() > 100_000
    lowest = np.arange(1200)
    while True:
        new = np.minimum(lowest, np.where(links, lowest, 1200).min(axis=1))
        if (new == lowest).all():
            break
        lowest = new
    assert [got[i]["component_id"] for i in range(1200)] == lowest.tolist()


def test_cells_that_cannot_be_split_are_compared_in_full(spark):
    rows = [(i, [1.0, 1e-4 * (i % 7) + 1e-6 * i], 1) for i in range(90)] + [(100, [0.0, 1.0], 1)]
    found, recall = flat_graph.near_vectors(vectors(spark, rows), flat_graph.FlatGraph(shard=10, levels=0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == {**{i: (89, 0) for i in range(90)}, 100: (0, 100)} and recall == 1


def test_vectors_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(flat_graph.F, "xxhash64", lambda *c: real(F.lit(1)) if len(c) == 3 and "(label, embedding, 0)" in str(real(*c)) else real(*c))
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.01], 1)]
    assert {r["vec_id"]: r["component_id"] for r in flat_graph.near_vectors(vectors(spark, rows))[0].collect()} == {1: 1, 2: 2, 3: 1}


def test_what_an_audit_cannot_measure_is_compared_in_full(spark, monkeypatch):
    """A sparse label over the shard size: its samples hold no links, and the one pair there is must still be found."""
    x = np.random.default_rng(12).normal(size=(600, 16))
    x[599] = x[3] + 1e-3
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    compared = []
    real = flat_graph.compare
    monkeypatch.setattr(flat_graph, "compare", lambda rows, how: compared.append(rows.count()) or real(rows, how))
    monkeypatch.setattr(flat_graph, "search", lambda cells, how: real_search(cells, how).where("false"))
    found, recall = flat_graph.near_vectors(vectors(spark, rows), flat_graph.FlatGraph(shard=60))
    got = {r["vec_id"]: r for r in found.collect()}
    assert compared == [600] and recall == 1 and all(r["recall_reached"] for r in got.values())
    assert {i for i, r in got.items() if r["n_links"]} == {3, 599} and got[599]["component_id"] == 3
    assert flat_graph.near_vectors(vectors(spark, rows[:50]), flat_graph.FlatGraph(shard=60))[1] == 1


real_search = flat_graph.search


def test_near_vectors_of_nothing_and_of_one(spark):
    found, recall = flat_graph.near_vectors(vectors(spark, []))
    assert found.count() == 0 and recall == 1
    one, _ = flat_graph.near_vectors(vectors(spark, [(7, [1.0] * 4, 1), (None, [1.0] * 4, 1), (8, [2.0] * 4, 1), (8, [2.0] * 4, 1)]))
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in one.collect()) == [(0, 0, 0), (7, 2, 7), (8, 2, 7), (8, 2, 7)]


def test_robust_prune_covers():
    x = blobs(50, 3).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    everyone = np.tile(np.arange(50), (50, 1))
    for i, kept in enumerate(flat_graph.robust_prune(x, everyone, 50, 1.2)):
        gap = lambda a, b: np.linalg.norm(x[a] - x[b])
        assert i not in kept
        for c in set(range(50)) - {i} - set(kept.tolist()):
            assert any(1.2 * gap(k, c) <= gap(i, c) + 1e-9 for k in kept)


def test_components(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (9, 3), (None, 4)] + [(500, i) for i in range(501, 560)]
    random.shuffle(edges)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (3, 5, 9)} == {3} and {got[i] for i in range(500, 560)} == {500}
    assert 7 not in got and 4 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k):
    q = {}
    for i, v, _ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v):
            q.setdefault(i, []).append([math.floor(256 * float(np.float32(c))) for c in v])
    out = []
    for i in q:
        if i % 50 == 0:
            mine = min(q[i])
            scores = sorted((-sum(a * b for a, b in zip(mine, o)), j) for j, os in q.items() if j != i for o in os if len(o) == len(mine))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bins", [4096, 7])
def test_top_k(spark, bins, monkeypatch):
    monkeypatch.setattr(histogram_topk, "BINS", bins)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 5)).astype(np.float32)
    x[20:80] = x[20]  # ties
    rows = [(i, x[i].tolist(), 0) for i in range(160)] + [(150, x[3].tolist(), 0)] + BAD[:6] + [(950, [1.0, 2.0], 0), (None, x[1].tolist(), 0), (1000, [1.0, 1.0], 0)]
    if bins == 4096:
        rows.append((960, [3e38] * 5, 0))
    table = vectors(spark, rows)
    asked = table.where("vec_id % 50 = 0")
    got = sorted(tuple(r) for r in histogram_topk.top_k(asked, table).collect())
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == [(*r[:3], clip(r[3])) for r in brute_top(rows, 5)]


def test_top_k_of_nothing(spark):
    empty = vectors(spark, [])
    some = vectors(spark, [(0, [1.0], 0)])
    assert histogram_topk.top_k(empty, some).count() == 0
    assert histogram_topk.top_k(some, empty).count() == 0
    assert histogram_topk.top_k(some, some).count() == 0


# -- chats

NASTY = ["", "<|im_end|>", "<|im_start|>assistant ok", "\\", "\\\\", "<\\|", "<|", "<\\\\|im_sep|>", "a<|im_sep|>b", "\n", "é漢😀", "<", "|>", "\\<|\\", "x" * 200_000]


def test_chats_round_trip(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for conv in range(60):
        turns = [(t, rng.choice(["user", "assistant", "assistant", "system", "we\nird<|im_nl|>", None]), rng.choice(NASTY[:-1] + [None])) for t in range(rng.randint(1, 9))]
        rows += [(conv, *t) for t in turns]
        expected[conv] = [(r or "", x or "") for _, r, x in turns]
    rows += [(None, 1, "user", "lost"), (77, 2, "assistant", NASTY[-1]), (77, None, "user", "first"), (78, 1, "b", "y"), (78, 1, "a", "z"), (78, 1, "a", "z")]
    expected |= {None: [("user", "lost")], 77: [("user", "first"), ("assistant", NASTY[-1])], 78: [("a", "z"), ("a", "z"), ("b", "y")]}
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as turns")
    made = chat_format.format_chats(frame)
    got = {r["conv_id"]: r for r in chat_format.read_chats(made).collect()}
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == expected
    spans = {r["conv_id"]: r["loss_spans"] for r in made.collect()}
    for k, turns in expected.items():
        assert got[k]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
        cut = [got[k]["formatted"][s["begin"] : s["end"]] for s in spans[k]]
        assert len(cut) == sum(r == "assistant" for r, _ in turns)
        blocks = sum(a != b for a, b in zip([None, *(r for r, _ in turns)], (r for r, _ in turns), strict=False))
        assert got[k]["formatted"].count("<|im_start|>") == blocks == got[k]["formatted"].count("<|im_end|>")
    assert hashlib.sha256(got[77]["loss_text"].encode()).hexdigest() == hashlib.sha256(NASTY[-1].encode()).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, chat_format.SLICE - 1, chat_format.SLICE, chat_format.SLICE + 1, 3 * chat_format.SLICE + 7):
        lengths = [i % 11 for i in range(n)]
        frame = spark.createDataFrame([(lengths,)], "x array<int>")
        got = frame.select(chat_format.running_sums(F.col("x"), 3).alias("s")).first()["s"]
        assert got == [sum(lengths[:i]) + 3 * i for i in range(n)]


def test_a_conversation_of_many_turns(spark):
    rng = random.Random(8)
    turns = [(t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 5)) for t in range(20_000)]
    frame = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(frame)
    got = chat_format.read_chats(made).first()
    assert [tuple(t) for t in got["turns"]] == [(r, x) for _, r, x in turns]
    assert got["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")


@pytest.mark.parametrize("roles", [["assistant"], ["user", "assistant"]])
def test_time_follows_the_turns(spark, roles):
    """Texts of ordinary length, of one role and alternating: twice the turns take about twice the time."""
    rng = random.Random(9)

    def took(n):
        texts = ["".join(rng.choice("abcdef <|") for _ in range(180)) for _ in range(n)]
        rows = [(1, t, roles[t % len(roles)], x) for t, x in enumerate(texts)]
        chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        begin = time.perf_counter()
        got = chat_format.read_chats(chats).first()
        end = time.perf_counter() - begin
        assert [t["text"] for t in got["turns"]] == texts and got["loss_text"] == "".join(x for t, x in enumerate(texts) if roles[t % len(roles)] == "assistant")
        return end

    took(1000)
    few = min(took(4000) for _ in range(2))
    assert min(took(8000) for _ in range(2)) < 2.5 * max(few, 0.5)


def test_spans_that_are_no_whole_texts(spark):
    chats = chat_format.format_chats(spark.createDataFrame([(1, 1, "assistant", "a<|b\\c"), (1, 2, "assistant", "déf")], "conv_id long, turn long, role string, text string"))
    whole = chats.first()["loss_spans"]
    begin, end, at, to = whole[0]["begin"], whole[0]["end"], whole[1]["begin"], whole[1]["end"]
    for spans, want in (([(begin, begin + 1)], "a"), ([(at + 1, to)], "éf"), ([(begin, end), (begin, end), (at, at)], "a<|b\\c" * 2), ([], "")):
        held = spark.createDataFrame([(spans,)], "loss_spans array<struct<begin:long,end:long>>")
        assert chat_format.read_chats(chats.drop("loss_spans").crossJoin(held)).first()["loss_text"] == want


def test_chats_of_nothing(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plans(spark):
    frame = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.read_chats(chat_format.format_chats(frame)).select(F.size("turns"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

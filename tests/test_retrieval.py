"""Search, ranking and retrieval metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import vectors
from foliant.operators import knn, ranking
from foliant.operators import retrieval_metrics as ret


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ids(*names):
    return F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, id string")


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == 1
    assert one(spark, vectors.cosine(v(1, 0), v(0, 2))) == 0
    assert one(spark, vectors.cosine(v(0, 0), v(1, 2))) == 0
    assert one(spark, vectors.cosine(F.array().cast("array<double>"), v(1))) == 0
    assert one(spark, vectors.cosine(v(1, 2, 9), v(1, 2))) == pytest.approx(5 / math.sqrt(86 * 5))
    assert one(spark, vectors.unit(v(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.unit(v(0, 0))) is None


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(150, 8))
    data[7] = data[3]
    rows = [(i, data[i].tolist(), i % 3) for i in range(150)] + [(150, [0.0] * 8, 0), (151, None, 0), (152, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    got = {}
    for r in knn.top_k(asked, table, 4, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i in range(150):
        best = sorted((-scores[i, j], j) for j in range(150) if j != i)[:4]
        assert [x[1] for x in sorted(got[i])] == [j for _, j in best]
    assert 150 not in got and 151 not in got and 152 not in got
    filtered = knn.top_k(asked, table, 2, {"label": 1}).join(table.select("vec_id", "label"), "vec_id")
    assert {r["label"] for r in filtered.collect()} == {1}


def test_top_k_leaves_out_what_is_not_finite(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [float("inf"), 1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("-inf"), 0.0]), (7, [1e300, 1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in knn.top_k(table.withColumnRenamed("vec_id", "query_id"), table, 2, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [1, 7], 1: [0, 7], 2: [7, 1], 7: [1, 0]}


def test_flagged_metrics_equal_pairs(spark):
    rng = np.random.default_rng(4)
    found = [(q, r + 1, f"d{i}") for q in range(20) for r, i in enumerate(rng.permutation(12)[:6])]
    pairs = [(q, f"d{i}") for q in range(18) for i in rng.permutation(12)[: rng.integers(0, 6)]]
    truth = spark.createDataFrame(pairs, "query_id int, id string")
    flagged = ranked(spark, found).join(truth.withColumn("relevant", F.lit(True)), ["query_id", "id"], "left")
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_relevant"))
    for k in (0, 3):
        assert sorted(map(str, ret.flagged_metrics(flagged, sizes, k).collect())) == sorted(map(str, ret.table_metrics(ranked(spark, found), truth, k).collect()))


def test_passage_hits_against_brute_force(spark):
    import random

    from foliant.operators.passages import passage_hits

    rng = random.Random(3)
    words = ["a", "bb", "ccc", "dd", "e\n", "ff  gg"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "")]
    passages = []
    for i in range(60):
        text = rng.choice(docs[:80])[1]
        at = rng.randint(0, max(0, len(text) - 1))
        passages.append((i, text[at : at + rng.randint(0, 40)]))
    passages += [(60, None), (61, "   "), (62, "not there at all in any of these documents")]
    got = passage_hits(spark.createDataFrame(passages, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, d) for p, x in passages if x and x.strip() for d, t in docs if t and x in t)


def test_short_passages_meet_words_and_no_loop_is_planned(spark, capsys):
    from foliant.operators.passages import passage_hits

    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "xalphax beta"), (3, None), (4, ""), (5, "b\u00e9ta  al"), (1, "alpha beta gamma")], "doc_id int, text string")
    asked = [(1, "alpha"), (2, "pha be"), (3, "a"), (4, " beta"), (5, "b\u00e9"), (6, "\u00e9ta  al"), (7, "alpha beta gamma"), (8, "alpha gamma"), (9, " "), (10, None), (11, "ax be"), (1, "alpha")]
    got = passage_hits(spark.createDataFrame(asked, "item_id int, text string"), docs)
    assert sorted(map(tuple, got.collect())) == sorted({(i, d) for i, p in asked if p and p.strip() for d, t in map(tuple, docs.collect()) if t and p in t})
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "item_id int, text string")
    assert passage_hits(none, docs).collect() == []
    assert passage_hits(spark.createDataFrame(asked, "item_id int, text string"), docs.limit(0)).collect() == []


def test_goldens_of_one_ranking(spark):
    found = ids("d1", "d2", "d3")
    assert one(spark, ret.recall_at_k(found, ids("d1", "d4"), 3)) == 0.5
    assert one(spark, ret.precision_at_k(found, ids("d1", "d4"), 3)) == pytest.approx(1 / 3)
    assert one(spark, ret.hit_rate(ids("d1", "d2"), ids("d1", "d3"), 2)) == 1
    assert one(spark, ret.hit_rate(ids("d2", "d4"), ids("d1", "d3"), 2)) == 0
    assert one(spark, ret.reciprocal_rank(ids("d2", "d1", "d3"), ids("d1"))) == 0.5
    assert one(spark, ret.recall_at_k(found, ids(), 3)) == 0
    assert one(spark, ret.recall_at_k(found, ids("d1"), 0)) == 0
    assert one(spark, ret.precision_at_k(ids("d1", "d1"), ids("d1"), 5)) == 0.5
    bundle = one(spark, ret.ranking_metrics(ids("d1", "d2", "d3", "d4", "d5"), ids("d1", "d3", "d6"), 5))
    assert (bundle["recall_at_k"], bundle["precision_at_k"], bundle["hit_rate"], bundle["mrr"]) == (pytest.approx(2 / 3), 0.4, 1, 1)
    whole = one(spark, ret.ranking_metrics(found, ids("d3"), 0))
    assert (whole["k"], whole["num_retrieved"], whole["recall_at_k"]) == (0, 3, 1)


def test_table_metrics(spark):
    rows = ranked(spark, [(1, 1, "d1"), (2, 1, "d3"), (3, 1, "d2"), (3, 2, "d1"), (3, 3, "d3"), (4, 1, "a"), (4, 2, "a")])
    truth = spark.createDataFrame([(1, "d1"), (1, "d2"), (2, "d3"), (3, "d1"), (4, "a")], "query_id int, id string")
    got = {r["query_id"]: r for r in ret.table_metrics(rows, truth, 5).collect()}
    assert (got[1]["recall_at_k"], got[1]["precision_at_k"]) == (0.5, 1)
    assert got[3]["mrr"] == 0.5
    assert got[4]["precision_at_k"] == 0.5
    mean = ret.averages(ret.table_metrics(rows.where("query_id < 3"), truth, 5)).first()
    assert (mean["recall_at_k"], mean["precision_at_k"], mean["num_queries"]) == (0.75, 1, 2)
    assert ret.averages(ret.table_metrics(rows.limit(0), truth, 5)).first()["mrr"] == 0


def test_stats(spark):
    docs = spark.createDataFrame([(1, 0.9, None), (1, None, 0.7), (2, None, None)], "query_id int, score double, rerank_score double")
    got = {r["query_id"]: r for r in ret.score_stats(docs).collect()}
    assert got[1]["avg_score"] == pytest.approx(0.8) and got[1]["score_std"] == pytest.approx(0.1)
    assert (got[2]["num_retrieved"], got[2]["avg_score"], got[2]["has_scores"]) == (1, 0, False)


def test_rerank_impact(spark):
    before = ranked(spark, [(1, 1, "d1"), (1, 2, "d2"), (1, 3, "d3"), (2, 1, "x")])
    after = ranked(spark, [(1, 1, "d2"), (1, 2, "d1"), (1, 3, "d3"), (2, 1, "y")])
    got = {r["query_id"]: r for r in ret.rerank_impact(before, after).collect()}
    assert (got[1]["order_changed"], got[1]["overlap_ratio"], got[1]["position_changes"]) == (True, 1, 2)
    assert (got[2]["overlap_ratio"], got[2]["position_changes"]) == (0, 0)
    truth = spark.createDataFrame([(1, "d2")], "query_id int, id string")
    change = {r["query_id"]: r for r in ret.metric_changes(before, after, truth).collect()}
    assert (change[1]["mrr_change"], change[1]["recall_at_k_change"]) == (0.5, 0)


def test_reranked(spark):
    rows = [(1, "engine fuel", 1, "a", "nothing here"), (1, "engine fuel", 2, "b", "engine and fuel"), (1, "engine fuel", 3, "c", "an engine"), (2, "  ", 1, "a", "x"), (2, "  ", 2, "b", "y"), (3, "of the", 1, "a", "x")]
    docs = spark.createDataFrame(rows, "query_id int, question string, rank int, id string, content string")
    got = [(r["query_id"], r["rank"], r["id"], r["rerank_score"]) for r in ranking.reranked(docs, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "b", 1.0), (1, 2, "c", 0.5), (2, 1, "a", None), (2, 2, "b", None), (3, 1, "a", 0.5)]
    assert [r["id"] for r in ranking.reranked(docs, 3, min_score=0.6).where("query_id = 1").collect()] == ["b"]
    failed = ranking.reranked(docs, 2, 0.9, F.when(F.col("id") == "b", F.lit(None)).otherwise(F.lit(0.1))).where("query_id = 1").orderBy("rank")
    assert [(r["id"], r["rerank_score"]) for r in failed.collect()] == [("a", 0.5), ("b", 0.5)]


def test_parsed_scores(spark):
    rows = [('{"1": 8, "2": 3}', 3, [0.8, 0.3, 0.5]), ("Document 1: 7", 1, [0.7]), ("[Document 2]: 4", 2, [0.5, 0.4]), ("none", 1, [0.5]), ('x {"1": "y", "2": 20} z', 2, [0.5, 1.0]), ("1=5", 1, [0.5]), (None, 1, [0.5]), ("{}", 0, [])]
    frame = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, t string, n int")
    got = [r["v"] for r in frame.select("i", ranking.parsed_scores(F.col("t"), F.col("n")).alias("v")).orderBy("i").collect()]
    assert got == [r[2] for r in rows]


def test_ordered_sources(spark):
    docs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "a"), (1, 4, None), (1, 5, "")], "query_id int, rank int, source string")
    assert ranking.ordered_sources(docs).first()["sources"] == ["a", "b", "unknown_source"]


def test_width():
    assert (ranking.width(True), ranking.width(False)) == (20, 5)

"""Reranking by a judge, calls with limits, outside metrics in evaluations, and questions without vectors."""

import json
import re
import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.engine import DEMO, Engine
from foliant.operators import evaluation, ranking
from foliant.providers import answering, embedding

DOCS = "query_id long, question string, rank int, id string, content string"


def judge_of(folder, answer):
    """A client that notes each call in a file of its own and answers by ``answer`` (question, documents)."""

    def make():
        def call(system, message):
            Path(folder, uuid.uuid4().hex).write_text(message)
            question, documents = message.removeprefix("Question: ").split("\n\nRate each document from 0 to 10 as JSON.\n\n", 1)
            return answer(question, re.split(r"(?:^|\n\n)\[Document \d+\]\n", documents)[1:])

        return call

    return make


def letters():
    def answer(question, documents):
        if "fail" in question:
            raise RuntimeError("down")
        if "talk" in question:
            return "I would rather not say."
        return json.dumps({str(i): d.count("x") for i, d in enumerate(documents, 1)})

    return answer


def test_a_judge_sees_all_candidates_of_a_question_at_once(spark, tmp_path):
    rows = [(1, "which", k, f"d{k}", "x" * n if n is not None else None) for k, n in enumerate((2, 9, None, 30, 9), 1)]
    rows += [(2, "do fail", k, f"d{k}", "x" * k) for k in (1, 2, 3)] + [(3, " ", k, f"d{k}", "x") for k in (1, 2)] + [(4, "talk", 1, "d1", "x")]
    scorer = answering.create_scorer("judge", provider=answering.RemoteAnswer(judge_of(tmp_path, letters()), attempts=2, wait=0.0, parallel=3))
    made = scorer.rerank(spark.createDataFrame(rows, DOCS).repartition(3), 3, 0.3).orderBy("query_id", "rank").collect()
    got = {}
    for r in made:
        got.setdefault(r["query_id"], []).append((r["id"], r["rerank_score"]))
    assert got[1] == [("d4", 1.0), ("d2", 0.9), ("d5", 0.9)]
    assert got[2] == [("d1", 0.5), ("d2", 0.5), ("d3", 0.5)] and got[3] == [("d1", None), ("d2", None)]
    assert got[4] == [("d1", 0.5)]
    # One call for each question that is asked, two for the one that fails, none for the blank one.
    assert len(list(tmp_path.iterdir())) == 1 + 2 + 1
    assert scorer.rerank(spark.createDataFrame([], DOCS), 3, 0.3).count() == 0
    assert made[0].asDict().keys() == {"query_id", "question", "rank", "id", "content", "rerank_score"}


def test_failed_judgements_are_not_cut_by_a_threshold(spark, tmp_path):
    rows = [(1, "fail", k, f"d{k}", "x") for k in range(1, 5)]
    scorer = answering.JudgeScorer(answering.RemoteAnswer(judge_of(tmp_path, letters()), attempts=1))
    got = scorer.rerank(spark.createDataFrame(rows, DOCS), 2, 0.9).orderBy("rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [("d1", ranking.NEUTRAL), ("d2", ranking.NEUTRAL)]


def test_the_engine_asks_a_judge(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    best = lambda question, documents: json.dumps({str(i): 10 if "Parquet" in d else 1 for i, d in enumerate(documents, 1)})
    engine = Engine(spark, root=f"file://{tmp_path}/store", seed_demo=True, dimension=64, scorer=answering.JudgeScorer(answering.RemoteAnswer(judge_of(calls, best))), rerank_min_score=0.5)
    asked = spark.createDataFrame([(1, "How does a vector search compare embeddings?"), (2, " ")], "query_id long, question string")
    got = {r["query_id"]: r for r in engine.ask(asked).collect()}
    assert got[1]["sources"] == ["parquet.md"] and got[1]["docs"][0]["rerank_score"] == 1.0 and got[2]["docs"] == []
    assert len(list(calls.iterdir())) == 1
    with pytest.raises(answering.NotConfigured):
        Engine(spark, root=f"file://{tmp_path}/store", reranker="judge")


def test_calls_are_side_by_side_paced_and_given_up(spark):
    def slow():
        def call(system, message):
            time.sleep(3.0 if message == "hangs" else 0.25)
            return message.upper()

        return call

    def took(provider, texts):
        frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
        begin = time.perf_counter()
        out = [r["a"] for r in frame.select(provider.generate(F.col("t")).alias("a")).collect()]
        return out, time.perf_counter() - begin

    texts = [f"t{i}" for i in range(16)]
    took(answering.RemoteAnswer(slow), ["warm"])
    one, alone = took(answering.RemoteAnswer(slow), texts)
    eight, beside = took(answering.RemoteAnswer(slow, parallel=8), [*texts, None])
    assert one == [t.upper() for t in texts] and eight == [*one, None] and beside < alone / 2
    _, paced = took(answering.RemoteAnswer(slow, parallel=16, rate=8), texts)
    assert paced >= 15 / 8
    given_up, _ = took(answering.RemoteAnswer(slow, parallel=4, attempts=1, timeout=1.0), ["a", "hangs", "b"])
    assert given_up == ["A", None, "B"]
    # The optimizer neither repeats nor removes calls: an answer that is used twice is the same answer.
    twice = spark.range(3).select(answering.RemoteAnswer(lambda: lambda s, m: uuid.uuid4().hex).generate(F.col("id").cast("string")).alias("a")).select(F.col("a").alias("b"), F.concat("a", F.lit("")).alias("c"))
    assert all(r["b"] == r["c"] for r in twice.collect())


def test_evaluations_hold_outside_metrics_when_there_is_a_client(spark, tmp_path):
    def client():
        def run(question, answer, contexts):
            if answer == "bad":
                raise RuntimeError("no score")
            return {"faithfulness": 0.5, "answer_relevancy": float(len(contexts))}

        return run

    runs = spark.createDataFrame([(1, "q", "good"), (2, "q", "bad"), (3, "q", None), (4, "q", "alone")], "query_id long, question string, answer string")
    docs = spark.createDataFrame([(i, 1, "d", "text", 0.5) for i in (1, 2, 3)], "query_id long, rank int, id string, content string, score double")
    on = evaluation.Evaluation(external=True)
    got = {r["query_id"]: r for r in evaluation.evaluate(runs, docs, how=on, client=client).collect()}
    assert got[1]["external"]["overall"] == 0.75 and got[1]["external"]["success"] and got[1]["generation"] is not None
    assert got[2]["external"]["success"] is False and got[2]["external"]["error"] == "no score" and got[2]["generation"] is not None
    assert got[3]["external"] is None and got[4]["external"] is None
    row = evaluation.summary(evaluation.evaluate(runs, docs, how=on, client=client)).first()
    assert row["avg_external_faithfulness"] == 0.5 and row["avg_external_overall"] == 0.75
    assert "external" not in evaluation.evaluate(runs, docs, client=client).columns and "external" not in evaluation.evaluate(runs, docs, how=on).columns
    assert evaluation.evaluate(runs, docs, how=evaluation.Evaluation(enabled=False, external=True), client=client).where("external is not null").isEmpty()
    engine = Engine(spark, root=f"file://{tmp_path}", seed_demo=True, dimension=64, evaluation=True, external_metrics=True, external=client)
    asked = spark.createDataFrame([(1, "What does Parquet keep?")], "query_id long, question string")
    assert engine.evaluate(engine.ask(asked)).first()["external"]["faithfulness"] == 0.5


def test_questions_without_a_vector_get_the_fixed_hits(spark, tmp_path):
    def client():
        def call(texts):
            if any("broken" in t for t in texts):
                raise RuntimeError("down")
            return [[float(len(t)), 1.0] for t in texts]

        return call

    provider = embedding.Remote(client, 2, batch=1, attempts=1)
    asked = spark.createDataFrame([(1, "a whole question"), (2, "a broken question"), (3, " ")], "query_id long, question string")
    for fallback in (True, False):
        engine = Engine(spark, root=f"file://{tmp_path}/{fallback}", embedder=provider, seed_demo=True, demo_fallback=fallback, reranking=False)
        got = {r["query_id"]: [d["id"] for d in r["docs"]] for r in engine.ask(asked).collect()}
        assert len(got[1]) == 5 and got[3] == []
        assert got[2] == ([d[0] for d in DEMO[:3]] if fallback else [])

"""Generation metrics, evaluation, context assembly, metadata."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation, generation, metadata
from foliant.operators import generation_metrics as gen


def measured(spark, answer, context):
    frame = spark.createDataFrame([(answer, context)], "answer string, context string")
    return gen.answer_metrics(frame).first()


def test_faithfulness_by_hand(spark):
    got = measured(spark, "Vector search finds similar chunks quickly", "Vector search compares chunks by meaning")
    # terms: vector search finds similar chunks quickly (6), 3 shared; bigrams: 5, 1 shared
    assert got["faithfulness_score"] == pytest.approx(0.6 * 3 / 6 + 0.4 * 1 / 5)
    assert got["context_coverage"] == pytest.approx(3 / 5)
    assert got["hallucination_risk"] == pytest.approx(0.5 * (1 - 0.38) + 0.5 * 0.5)
    assert (got["answer_word_count"], got["key_terms_in_answer"], got["total_key_terms"]) == (6, 3, 5)


@pytest.mark.parametrize(("answer", "context", "faith", "cover", "risk"), [("", "some context", 0, 0, 1), ("words here", "  ", 0, 0, 1), ("of it", "some context", 1, 0, 0), ("words here", "of it", 0, 1, 1), (None, None, 0, 0, 1)])
def test_edges(spark, answer, context, faith, cover, risk):
    got = measured(spark, answer, context)
    assert (got["faithfulness_score"], got["context_coverage"], got["hallucination_risk"]) == (faith, cover, risk)


def test_averages_of_nothing(spark):
    empty = gen.answer_metrics(spark.createDataFrame([], "answer string, context string"))
    assert gen.averages(empty).first().asDict() == {"avg_faithfulness_score": 0, "avg_context_coverage": 0, "avg_hallucination_risk": 0, "avg_answer_length": 0, "avg_answer_word_count": 0, "num_answers": 0}


def test_context_text(spark):
    docs = F.array(F.struct(F.lit("a").alias("content"), F.lit("x").alias("text")), F.struct(F.lit("").alias("content"), F.lit("b").alias("text")))
    assert spark.range(1).select(gen.context_text(docs).alias("v")).first()["v"] == "a b"


def test_context_and_answers(spark):
    docs = spark.createDataFrame([(1, 2, "Second. Cats purr loudly.", None), (1, 1, "First text. Dogs bark loudly.", "a.txt")], "query_id int, rank int, content string, source string")
    row = generation.contexts(docs).withColumn("question", F.lit("do dogs bark")).select("context", generation.prompt(F.col("context"), F.col("question")).alias("p"), generation.extractive_answer(F.col("question"), F.col("docs")).alias("a")).first()
    assert row["context"] == "Document 1 (from a.txt):\nFirst text. Dogs bark loudly.\n\nDocument 2 (from unknown):\nSecond. Cats purr loudly."
    assert row["p"].startswith("Context:\n---\nDocument 1") and row["p"].endswith("---\n\nQuestion: do dogs bark")
    assert row["a"] == "Dogs bark loudly."


def test_listed_answer(spark):
    docs = F.array(F.struct(F.lit(1).alias("rank"), F.lit("d").alias("id"), F.lit("s").alias("source"), F.lit(0.123456).alias("score")))
    got = spark.range(1).select(generation.listed_answer(docs).alias("v")).first()["v"]
    assert got == "Based on 1 retrieved documents:\n  1. d (score: 0.1235) from s"


def test_evaluate(spark):
    runs = spark.createDataFrame([(1, "q", "cats purr"), (2, "q", "")], "query_id int, question string, answer string")
    docs = spark.createDataFrame([(1, 1, "a", "cats purr", 0.9), (1, 2, "b", "dogs", 0.7), (2, 1, "a", "x", None)], "query_id int, rank int, id string, content string, score double")
    truth = spark.createDataFrame([(1, "b")], "query_id int, id string")
    got = {r["query_id"]: r for r in evaluation.evaluate(runs, docs, truth).collect()}
    assert got[1]["retrieval"]["mrr"] == 0.5 and got[2]["retrieval"] is None
    assert got[1]["generation"]["faithfulness_score"] == 1 and got[2]["generation"] is None
    assert got[2]["stats"]["has_scores"] is False
    total = evaluation.summary(evaluation.evaluate(runs, docs, truth)).first()
    assert (total["num_evaluations"], total["avg_mrr"]) == (2, 0.5)
    assert evaluation.evaluate(runs, docs).where("retrieval is not null").count() == 0
    off = evaluation.evaluate(runs, docs, None, evaluation.Evaluation(enabled=False)).first()
    assert off["stats"] is None


def test_history(spark, tmp_path):
    runs = spark.createDataFrame([(1, "q", "cats purr")], "query_id int, question string, answer string")
    docs = spark.createDataFrame([(1, 1, "a", "cats purr", 0.9)], "query_id int, rank int, id string, content string, score double")
    history = evaluation.History(f"file://{tmp_path}/h")
    for _ in range(2):
        history.add(evaluation.evaluate(runs, docs))
    assert history.read(spark).count() == 2
    history.clear(spark)
    assert not (tmp_path / "h").exists()


def test_external_metrics(spark):
    def client():
        def run(question, answer, contexts):
            if not contexts:
                raise ValueError("no context")
            return {"faithfulness": 1.0, "context_recall": 0.5}

        return run

    runs = spark.createDataFrame([(1, "q", "a"), (2, "q", "a")], "query_id int, question string, answer string")
    docs = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "query_id int, rank int, content string")
    data = evaluation.external_dataset(runs, docs)
    assert {r["query_id"]: r["contexts"] for r in data.collect()} == {1: ["x", "y"], 2: None}
    got = {r["query_id"]: r for r in evaluation.external_metrics(data, client).collect()}
    assert (got[1]["overall"], got[1]["success"]) == (0.75, True) and (got[2]["overall"], got[2]["error"]) == (None, "no context")
    assert evaluation.external_status(None) == {"available": False, "metrics": []}


def test_external_overall(spark):
    v = spark.range(1).select(evaluation.external_overall(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5)).alias("v"), evaluation.external_overall(F.lit(None).cast("double")).alias("w")).first()
    assert (v["v"], v["w"]) == (0.75, None)


def test_metadata(spark):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    row = spark.range(1).select(
        metadata.merged(m(a="1", b="2"), m(b="3", c="")).alias("m"),
        metadata.cleaned(metadata.merged(m(a="1"), m(c=""))).alias("c"),
        metadata.chunk_id(F.lit("f.txt"), F.lit(2), F.lit("abc")).alias("i"),
        metadata.document_id(F.lit("f.txt"), F.lit("/x")).alias("d"),
        metadata.chunk_position(F.lit(0), F.lit(3)).alias("p"),
    ).first()
    assert row["m"] == {"a": "1", "b": "3", "c": ""} and row["c"] == {"a": "1"}
    assert row["i"] == "f.txt_chunk_2_90015098" and row["p"] == "1 of 3"
    assert row["d"].startswith("doc_f.txt_") and len(row["d"]) == len("doc_f.txt_") + 8


def test_storable_and_batch(spark):
    frame = spark.sql("select 'x' a, cast(null as string) b, array(1, 2) c, timestamp'2024-01-02 03:04:05' d")
    assert frame.select(metadata.storable(frame, "a", "b", "c", "d").alias("m")).first()["m"] == {"a": "x", "c": "[1,2]", "d": "2024-01-02T03:04:05.000000Z"}
    assert metadata.batch_id(spark).startswith("batch_20")


def test_a_cleared_history_is_empty(spark, tmp_path):
    runs = spark.createDataFrame([(1, "q", "cats purr")], "query_id int, question string, answer string")
    docs = spark.createDataFrame([(1, 1, "a", "cats purr", 0.9)], "query_id int, rank int, id string, content string, score double")
    history = evaluation.History(f"file://{tmp_path}/h")
    assert history.read(spark).isEmpty()
    history.add(evaluation.evaluate(runs, docs))
    schema = history.read(spark).schema
    history.clear(spark)
    assert history.read(spark).isEmpty() and history.read(spark, schema).where("generation is not null").isEmpty()
    history.add(evaluation.evaluate(runs, docs))
    assert history.read(spark).count() == 1


def test_the_history_query_clears(spark, monkeypatch):
    """What is there after clearing is a part of the result: without it every run would come twice."""
    from foliant.plans import more_queries

    cleared, real = [], evaluation.History.clear
    monkeypatch.setattr(evaluation.History, "clear", lambda self, spark: (cleared.append(self), real(self, spark))[1])
    rows = more_queries.evaluation_history(spark, "/root/testdata/sf0.001").collect()
    assert len(cleared) == 1 and cleared[0].read(spark).isEmpty()
    assert rows and {r["n"] for r in rows} == {2} and len({r["query_id"] for r in rows}) == len(rows)

"""Settings, registries and fixed lists, which need no table."""

import pytest
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.operators import chunking, collection, evaluation, metadata, ranking
from foliant.providers import answering, embedding
from foliant.sources import files


def test_formats(spark):
    assert sorted(map(tuple, files.formats(spark).collect())) == sorted([(".txt", "text"), (".text", "text"), (".md", "text"), (".markdown", "text"), (".html", "html"), (".htm", "html"), (".pdf", "pdf"), (".docx", "docx")])


def test_scores_of_odd_responses(spark):
    rows = [
        (1, '{"1": 8, "2": 3}', 3, [0.8, 0.3, 0.5]), (2, "Document 1: 7 and Document 2: 12", 2, [0.7, 1.0]), (3, "[Document 2]: 4.5", 2, [0.5, 0.45]), (4, "no scores at all", 2, [0.5, 0.5]),
        (5, 'text {"1": "x", "3": 9, "2": -4} more', 3, [0.5, 0.0, 0.9]), (6, "1=5, 2: 6", 2, [0.5, 0.6]), (7, '{"9": 5}', 1, [0.5]),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "id int, response string, n int")
    got = {r["id"]: r["s"] for r in frame.select("id", ranking.parsed_scores(F.col("response"), F.col("n")).alias("s")).collect()}
    assert got == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize(("size", "overlap"), [(512, 512), (0, 0), (10, -1)])
def test_sizes_that_are_refused(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.recursive_chunks(F.lit(""), size, overlap)


def test_semantic_settings_fall_back():
    assert chunking.Semantic().fixed() == chunking.Semantic()
    assert chunking.Semantic(2.0).fixed() == chunking.Semantic() and chunking.Semantic(0.5, 2000, 1000).fixed() == chunking.Semantic(0.5, 250, 1000)


def test_batch_ids_differ(spark):
    import re

    names = [metadata.batch_id(spark) for _ in range(2)]
    assert len(set(names)) == 2 and all(re.fullmatch(r"batch_\d{8}_\d{6}_[0-9a-f]{8}", n) for n in names)


def test_registries(spark):
    assert embedding.create("hashed", dimension=64).dimension() == 64 and embedding.create("hashed").name == "hashed-terms"
    assert answering.create_answer("extractive").name == "extractive" and answering.create_scorer("lexical").name == "lexical"
    for make in (embedding.create, answering.create_answer, answering.create_scorer, lambda n: collection.create(n, spark, "x")):
        with pytest.raises(ValueError, match="no such provider"):
            make("no such provider")
    assert (ranking.width(True), ranking.width(False)) == (20, 5)
    assert evaluation.external_status(object()) == {"available": True, "metrics": list(evaluation.EXTERNAL)} and not evaluation.external_status(None)["available"]


def test_settings_are_shown_without_secrets(spark):
    made = Settings.of(spark, store_root="/r", embedding_provider="remote", answer_api_key="secret", final_top_k=7)
    shown = made.described()
    assert (shown["answer_api_key"], shown["embedding_api_key"], shown["storage_mode"], shown["final_top_k"], shown["chunk_size"]) == ("***", "", "path", 7, 512)
    assert made.problems() == ["embedding_api_key is not set"]

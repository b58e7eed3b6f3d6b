"""Documents whose ids, which hold 32 bits of a digest, are the same."""

from foliant.engine import Engine
from foliant.operators import metadata

#: Two paths that give documents of the source "s" the same id.
PATHS = ("/corpus/69362", "/corpus/100040")


def test_positions_of_documents_that_share_an_id(spark):
    rows = [("s", p, f"{p} {i}", i) for p, n in zip(PATHS, (2, 3), strict=True) for i in range(n)]
    made = metadata.with_total(metadata.enriched(spark.createDataFrame(rows, "source string, file_path string, chunk_text string, chunk_index int")))
    assert made.select("document_id").distinct().count() == 1
    assert {(r["file_path"], r["total_chunks"]) for r in made.collect()} == {(PATHS[0], 2), (PATHS[1], 3)}


def test_status_of_documents_that_share_an_id(spark, tmp_path):
    engine = Engine(spark, root=str(tmp_path), dimension=8, chunking="recursive", chunk_size=60, chunk_overlap=0)
    docs = [("word " * n, "s", p) for p, n in zip(PATHS, (20, 50), strict=True)]
    made = engine.ingest(spark.createDataFrame(docs, "text string, source string, file_path string")).collect()
    assert len({r["document_id"] for r in made}) == 1
    assert sorted(r["chunk_count"] for r in made) == [2, 5]

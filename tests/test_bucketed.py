"""The bucketed store, typed metadata, and streams into it."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from foliant.engine import Engine
from foliant.operators import collection
from foliant.operators.bucketed import BucketedStore
from foliant.streaming import ingest

POINTS = "doc_id string, parent string, text string, embedding array<float>, metadata struct<label:int,flag:boolean,tags:array<string>,inner:struct<x:double>>"


def points(spark, rows):
    """(doc_id, parent, text, vector, label) with metadata of several types."""
    return spark.createDataFrame([(d, p, t, v, (n, n % 2 == 0, [t, str(n)], (n / 2,))) for d, p, t, v, n in rows], POINTS)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    made = BucketedStore(spark, f"file://{tmp_path}/store", buckets=8, fields={"label": "int"})
    assert made.create("c", 2) and not made.create("c", 3) and made.exists("c")
    return made


def held(store, *extra):
    return sorted((r["doc_id"], r["text"], *(r[e] for e in extra)) for r in store.read("c").collect())


def test_a_merge_rewrites_the_buckets_it_touches(spark, store, tmp_path):
    first = [(f"d{i}", None, f"t{i}", [1.0, float(i)], i) for i in range(200)]
    assert store.upsert("c", points(spark, first)) and store.count("c") == 200
    before = files(tmp_path)
    buckets = {r["doc_id"]: r["bucket"] for r in store.read("c").collect()}
    changed = [("d3", None, "new", [0.0, 1.0], 3), ("d4", None, "new", [0.0, 1.0], 4), ("more", None, "new", [0.0, 1.0], 5)]
    assert store.upsert("c", points(spark, changed))
    after = files(tmp_path)
    touched = {r["bucket"] for r in store.read("c").where("text = 'new'").collect()}
    of = lambda paths: {int(p.split("bucket=")[1].split("/")[0]) for p in paths}
    assert of(before - after) == of(after - before) == touched and len(touched) <= 3 and {buckets["d3"], buckets["d4"]} <= touched
    want = {d: t for d, _, t, *_ in first} | {"d3": "new", "d4": "new", "more": "new"}
    assert held(store) == sorted(want.items())
    numbers = [r["vec_id"] for r in store.read("c").collect()]
    assert len(set(numbers)) == len(numbers) == 201
    # The same again changes nothing, and no staging is left.
    assert store.upsert("c", points(spark, changed)) and held(store) == sorted(want.items())
    assert not files(f"{tmp_path}/store/staging")


def test_deletes_and_empty_buckets(spark, store):
    store.upsert("c", points(spark, [(f"d{i}", None, "t", [1.0, 0.0], i) for i in range(40)]))
    assert store.delete("c", spark.createDataFrame([("d1",), ("none",)], "doc_id string"))
    assert store.count("c") == 39
    assert store.delete("c", store.read("c").select("doc_id")) and store.count("c") == 0
    assert store.delete("c", spark.createDataFrame([], "doc_id string")) and store.delete("missing", spark.createDataFrame([("x",)], "doc_id string"))
    assert store.upsert("c", points(spark, [("again", None, "t", [1.0, 0.0], 1)])) and held(store) == [("again", "t")]


def test_replace_takes_what_a_parent_no_longer_has(spark, store):
    store.upsert("c", points(spark, [("a0", "A", "x", [1.0, 0.0], 0), ("a1", "A", "y", [1.0, 0.0], 1), ("b0", "B", "z", [1.0, 0.0], 2), ("a0", "B", "same id", [1.0, 0.0], 3)]))
    assert len(held(store)) == 4
    store.upsert("c", points(spark, [("a0", "A", "new", [1.0, 0.0], 0)]), mode="replace")
    assert held(store, "parent") == [("a0", "new", "A"), ("a0", "same id", "B"), ("b0", "z", "B")]
    store.upsert("c", points(spark, [("a1", "A", "y", [1.0, 0.0], 1)]), mode="merge")
    store.upsert("c", points(spark, [("a1", "A", "y", [1.0, 0.0], 1)]), mode="append")
    assert [d for d, *_ in held(store)].count("a1") == 2
    with pytest.raises(ValueError, match="mode"):
        store.upsert("c", points(spark, []), mode="other")


def test_what_is_refused(spark, store):
    assert not store.upsert("missing", points(spark, [("d", None, "t", [1.0, 0.0], 1)]))
    assert not store.upsert("c", points(spark, [("d", None, "t", [1.0, 0.0], 1), ("e", None, "t", [1.0], 1)]))
    assert not store.upsert("c", points(spark, [("d", None, "t", None, 1)])) and store.count("c") == 0
    assert store.upsert("c", points(spark, [])) and store.read("missing").count() == 0
    # Repeated points: the last by text wins, whatever order they come in.
    rows = [("d", None, "a", [1.0, 0.0], 1), ("d", None, "b", [0.0, 1.0], 2), ("d", None, None, [1.0, 1.0], 3)]
    for some in (rows, rows[::-1]):
        store.upsert("c", points(spark, some))
        assert held(store) == [("d", "b")]


def test_types_come_back_and_filters_reach_the_scan(spark, store):
    store.upsert("c", points(spark, [(f"d{i}", None, f"t{i}", [1.0, float(i)], i) for i in range(20)]))
    asked = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, [1.0])], "query_id long, embedding array<float>")
    hit = store.search("c", asked, 1).where("query_id = 1").select("id", "metadata", F.to_json("payload").alias("json"), F.schema_of_variant("payload").alias("kinds")).first()
    assert hit["id"] == "d3" and hit["metadata"]["label"] == "3" and hit["metadata"]["flag"] == "false"
    assert hit["json"] == '{"flag":false,"inner":{"x":1.5},"label":3,"tags":["t3","3"]}'
    assert "label: BIGINT" in hit["kinds"] and "flag: BOOLEAN" in hit["kinds"] and "tags: ARRAY<STRING>" in hit["kinds"]
    assert {r["query_id"] for r in store.search("c", asked, 2).collect()} == {1}
    plan = store.matching("c", {"label": 4})._jdf.queryExecution().toString()
    assert "EqualTo(f_label,4)" in plan or "f_label" in plan.split("PushedFilters")[1].split("]")[0]
    assert [r["doc_id"] for r in store.matching("c", {"label": 4}).collect()] == ["d4"]
    assert [r["doc_id"] for r in store.matching("c", {"label": 4, "flag": True}).collect()] == ["d4"]
    assert store.matching("c", {"flag": False}).count() == 10 and store.matching("c", {"flag": True, "label": 3}).count() == 0
    assert store.matching("c", {"none": None}).count() == 20 and store.matching("c", {"none": "x"}).count() == 0
    for bad in ({"it's": 1}, {"label": [1]}):
        with pytest.raises(ValueError):
            store.matching("c", bad)


def test_metadata_may_be_a_map_or_null(spark, store):
    rows = [("a", "t", [1.0, 0.0], {"label": "7", "k": "v"}), ("b", "t", [1.0, 0.0], None)]
    store.upsert("c", spark.createDataFrame(rows, "doc_id string, text string, embedding array<float>, metadata map<string,string>"))
    assert {r["doc_id"]: r["f_label"] for r in store.read("c").collect()} == {"a": 7, "b": None}
    assert [r["doc_id"] for r in store.matching("c", {"k": "v"}).collect()] == ["a"]


def test_the_engine_over_a_bucketed_store(spark, tmp_path):
    engine = Engine(spark, root=f"file://{tmp_path}/store", store_provider="bucketed", dimension=64, chunking="sentence", reranking=False)
    docs = spark.createDataFrame([("Rivers carry stones to the harbour.", "a.txt"), ("Windows face the garden in winter.", "b.txt")], "text string, source string")
    assert all(r["success"] for r in engine.ingest(docs).collect())
    asked = spark.createDataFrame([(1, "which stones do rivers carry")], "query_id long, question string")
    row = engine.ask(asked).first()
    assert row["sources"][0] == "a.txt"
    assert [r["source"] for r in engine.retrieve(asked, where={"source": "b.txt"}).collect()] == ["b.txt"]
    assert isinstance(engine.store, BucketedStore) and engine.store.info(engine.settings.collection).first()["total_points"] == 2
    first = engine.store.read(engine.settings.collection).select(F.try_variant_get("metadata", F.lit("$.chunk_index"), "bigint").alias("i"), F.try_variant_get("metadata", F.lit("$.ingested_at"), "string").alias("at")).first()
    assert first["i"] == 0 and datetime.datetime.fromisoformat(first["at"])


def test_files_streamed_into_a_collection(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "one.txt").write_text("Rivers carry stones. Letters cross the harbour.")
    (docs / "two.html").write_text("<html><body><p>Windows face the garden.</p></body></html>")
    (docs / "bad.xyz").write_text("?")
    engine = Engine(spark, root=f"file://{tmp_path}/store", store_provider="bucketed", dimension=64, chunking="sentence")
    run = lambda checkpoint="cp": ingest.ingest_stream(engine, ingest.file_stream(spark, f"file://{docs}"), f"file://{tmp_path}/{checkpoint}", f"file://{tmp_path}/statuses", prepare=engine.loaded).awaitTermination()
    texts = lambda: sorted(r["text"] for r in engine.store.read(engine.settings.collection).collect())
    run()
    assert texts() == ["Rivers carry stones. Letters cross the harbour.", "Windows face the garden."]
    statuses = {r["document_name"]: (r["success"], r["error"], r["chunk_count"]) for r in spark.read.parquet(f"{tmp_path}/statuses").collect()}
    assert statuses == {"one.txt": (True, None, 1), "two.html": (True, None, 1), "bad.xyz": (False, "unsupported file type", 0)}
    run()
    (docs / "three.md").write_text("A cloud over the window.")
    run()
    assert len(texts()) == 3 and spark.read.parquet(f"{tmp_path}/statuses").where("batch = 1").count() == 1
    # All from the beginning by a new checkpoint: the same points.
    before = texts()
    run("another")
    assert texts() == before


def test_a_stream_repeats_a_failed_micro_batch(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(6):
        (docs / f"d{i}.txt").write_text(f"Text number {i} about rivers and gardens.")
    engine = Engine(spark, root=f"file://{tmp_path}/store", store_provider="bucketed", dimension=64, chunking="sentence")
    real, calls = engine.store._replace, []

    def killed(*args):
        real(*args)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("killed after the points were written")

    monkeypatch.setattr(engine.store, "_replace", killed)
    run = lambda: ingest.ingest_stream(engine, ingest.file_stream(spark, f"file://{docs}"), f"file://{tmp_path}/cp", f"file://{tmp_path}/statuses", prepare=engine.loaded).awaitTermination()
    with pytest.raises(Exception, match="killed after"):
        run()
    assert engine.store.count(engine.settings.collection) == 6
    run()
    assert engine.store.count(engine.settings.collection) == 6 and spark.read.parquet(f"{tmp_path}/statuses").count() == 6


def test_the_versioned_store_leaves_no_staging(spark, tmp_path):
    store = collection.create("parquet", spark, f"file://{tmp_path}/v")
    store.create("c", 2)
    rows = points(spark, [("a", None, "t", [1.0, 0.0], 1)]).drop("parent", "metadata").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    assert store.upsert("c", rows) and store.upsert("c", rows, mode="append") and not store.upsert("c", rows.withColumn("embedding", F.array(F.lit(1.0))))
    assert store.count("c") == 2 and not files(f"{tmp_path}/v/staging")


def test_versions_are_whole_and_points_are_numbered(spark, tmp_path):
    """Appending makes a new version: a reader of the one before sees no new point; points that share a hash of their id keep their texts."""
    store = collection.create("parquet", spark, f"file://{tmp_path}/v")
    store.create("c", 2)
    rows = lambda names: points(spark, [(n, None, f"text {n}", [1.0, float(i)], 1) for i, n in enumerate(names)]).select("doc_id", "text", "embedding", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    store.upsert("c", rows(["a", "b"]), mode="append")
    before = store.read("c")
    store.upsert("c", rows(["c", "a"]), mode="append")
    assert before.count() == 2 and store.count("c") == 4
    numbers = [r["vec_id"] for r in store.read("c").collect()]
    assert len(set(numbers)) == 4
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert sorted(r["text"] for r in store.search("c", asked, 4).collect()) == ["text a", "text a", "text b", "text c"]


def test_an_ingestion_leaves_no_chunks_behind(spark, tmp_path):
    """Chunks are written once beside the collection and gone afterwards; statuses are read from counts."""
    engine = Engine(spark, root=f"file://{tmp_path}/store", store_provider="bucketed", dimension=64, chunking="sentence")
    docs = spark.createDataFrame([(f"Rivers carry {i} stones to the harbour.", f"{i}.txt") for i in range(60)], "text string, source string")
    for _ in range(2):
        statuses = engine.ingest(docs, mode="replace")
        columns = [set(spark.read.parquet(f"file://{d}").columns) for d in (tmp_path / "store" / "staging").iterdir()]
        assert not any("chunk_text" in c or "embedding" in c for c in columns)
        assert statuses.where("success and chunk_count = 1").count() == 60 and engine.store.count(engine.settings.collection) == 60


def test_buckets_are_rewritten_some_at_a_time(spark, tmp_path):
    """More buckets than are rewritten at once: merged, replaced and deleted points, each in its bucket with a number of its own."""
    store = BucketedStore(spark, f"file://{tmp_path}/store", buckets=40, fields={"label": "int"})
    store.create("c", 2)
    rows = [(f"d{i}", f"p{i % 90}", f"t{i}", [1.0, float(i)], i) for i in range(300)]
    assert store.upsert("c", points(spark, rows)) and store.count("c") == 300
    store.upsert("c", points(spark, [(d, p, "new", v, n) for d, p, _, v, n in rows[:150]]))
    assert sorted(t for _, t in held(store)) == sorted(["new"] * 150 + [f"t{i}" for i in range(150, 300)])
    store.upsert("c", points(spark, [("only", f"p{i}", "o", [1.0, 0.0], i) for i in range(90)]), mode="replace")
    assert held(store) == [("only", "o")] * 90 and len({r["vec_id"] for r in store.read("c").collect()}) == 90

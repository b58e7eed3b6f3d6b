"""The jobs over growing copies of input: what is new, repeats, failures, settings and command lines."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.text import Normalization, normalized
from foliant.operators.chunking import recursive_chunks
from jobs import common, index_documents, retrieval_report

DOCS = "doc_id long, text string, source string, lang string"
ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def write(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def chunks_of(spark, rows):
    """(doc_id, place, text) of the chunks of documents, by the library's expressions on the whole table."""
    frame = spark.createDataFrame(rows, DOCS)
    made = frame.select("doc_id", F.posexplode(recursive_chunks(normalized(F.coalesce("text", F.lit("")), Normalization(page_markers=False)), 512, 50)))
    return sorted((r["doc_id"], r["pos"], r["col"]) for r in made.collect())


def held(spark, out):
    return sorted((r["doc_id"], r["chunk_index"], r["chunk_text"]) for r in index_documents.current(spark, out).collect())


def long_text(seed, n=400):
    words = ["river", "stone", "cloud", "harbour", "letter", "window", "garden", "winter"]
    return " ".join(words[(seed * 7 + i * i) % 8] + ("." if i % 9 == 8 else "") for i in range(n))


def test_index_takes_only_what_is_new(spark, tmp_path):
    docs, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "checkpoint"))
    first = [(1, long_text(1), "a", "en"), (2, "short", "a", "de"), (3, "", None, None), (4, None, "b", "en"), (None, "lost", "b", "en"), (5, long_text(5), None, None), (5, long_text(5), None, None)]
    write(spark, docs, first)
    report = index_documents.index_documents(spark, docs, out, checkpoint)
    assert report["batches"] == 1 and report["documents"] == 5
    assert held(spark, out) == chunks_of(spark, [r for r in first[:4] + first[5:6]])
    again = index_documents.index_documents(spark, docs, out, checkpoint)
    assert again == {"batches": 0, "documents": 0, "chunks": 0} and held(spark, out) == chunks_of(spark, first[:4] + first[5:6])

    changed = (2, long_text(2), "a", "de")
    write(spark, docs, [first[0], changed, (6, "a new one", "c", "fr"), (7, "", "c", "fr")])
    assert index_documents.index_documents(spark, docs, out, checkpoint)["documents"] == 3
    assert held(spark, out) == chunks_of(spark, [first[0], changed, first[2], first[3], first[5], (6, "a new one", "c", "fr"), (7, "", "c", "fr")])
    states = {(r["doc_id"], r["batch"]): r for r in spark.read.parquet(f"{out}/documents").collect()}
    assert set(states) == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (2, 1), (6, 1), (7, 1)}
    assert states[3, 0]["error"] == "no text" and states[3, 0]["n_chunks"] == 0 and states[3, 0]["source"] == "unknown" and states[3, 0]["lang"] == "und"
    assert states[6, 1]["error"] is None and states[6, 1]["n_chunks"] == 1

    # A document that loses its text has no current chunks.
    write(spark, docs, [(6, " ", "c", "fr")])
    index_documents.index_documents(spark, docs, out, checkpoint)
    assert 6 not in {d for d, *_ in held(spark, out)}


def test_index_repeats_a_failed_micro_batch(spark, tmp_path, monkeypatch):
    docs, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "checkpoint"))
    rows = [(i, long_text(i, 150), "ab"[i % 2], "en") for i in range(12)]
    write(spark, docs, rows)
    real, calls = index_documents.overwrite_partitions, []

    def breaks(frame, path, *by):
        calls.append(path)
        if path.endswith("documents") and len(calls) == 2:
            raise RuntimeError("the driver is lost")
        real(frame, path, *by)

    monkeypatch.setattr(index_documents, "overwrite_partitions", breaks)
    with pytest.raises(Exception, match="the driver is lost"):
        index_documents.index_documents(spark, docs, out, checkpoint)
    assert spark.read.parquet(f"{out}/chunks").count() > 0 and held(spark, out) == []
    write(spark, docs, [(100, "later", "a", "en")])
    index_documents.index_documents(spark, docs, out, checkpoint)
    assert held(spark, out) == chunks_of(spark, [*rows, (100, "later", "a", "en")])
    assert spark.read.parquet(f"{out}/chunks").groupBy("chunk_id", "doc_id").count().where("count > 1").isEmpty()
    # The same micro-batch once more, and one with the rows in another order, leave the same files' rows.
    index_documents.take(spark.createDataFrame(rows[::-1], DOCS), 0, out, index_documents.Config())
    assert held(spark, out) == chunks_of(spark, [*rows, (100, "later", "a", "en")])


def test_index_by_several_micro_batches(spark, tmp_path):
    docs, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "checkpoint"))
    for i in range(3):
        write(spark, docs, [(i, long_text(i, 60), "a", "en"), (9, long_text(20 + i, 60), "a", "en")])
    how = index_documents.Config(files_per_batch=1)
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    assert index_documents.index_documents(spark, docs, out, checkpoint, how)["batches"] == 3
    assert spark.conf.get("spark.sql.files.maxRecordsPerFile") == before
    newest = spark.read.parquet(f"{out}/documents").where("doc_id = 9").orderBy(F.desc("batch")).first()
    assert newest["batch"] == 2
    got = held(spark, out)
    assert {d for d, *_ in got} == {0, 1, 2, 9} and len([1 for d, k, _ in got if d == 9 and k == 0]) == 1


def test_index_of_nothing(spark, tmp_path):
    docs, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("docs", "out", "checkpoint"))
    write(spark, docs, [])
    index_documents.index_documents(spark, docs, out, checkpoint)
    assert held(spark, out) == []


def brute_report(vectors, documents, k=5):
    ids = [i for i, *_ in vectors]
    label, kind = {i: x for i, x, _ in vectors}, {d: (s, x) for d, _, s, x in documents}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in vectors}
    out = {}
    for i in ids:
        ranked = sorted((j for j in ids if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:k]
        hits = [j for j in ranked if label[j] is not None and label[j] == label[i]]
        relevant = sum(label[j] == label[i] for j in ids) - 1 if label[i] is not None else 0
        place = next((r for r, j in enumerate(ranked, 1) if j in hits), None)
        out[i] = (kind.get(i, (None, None)), len(hits) / relevant if relevant else 0.0, len(hits) / len(ranked), float(bool(hits)), 1 / place if place else 0.0, round(max(float(unit[i] @ unit[j]) for j in ranked), 6))
    return out


def test_report_against_brute_force_and_run_by_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(i, None if i == 3 else i % 4, (rng.normal(size=6) + 2 * np.eye(6)[i % 4]).tolist()) for i in range(60)]
    documents = [(i, "x", "s" + str(i % 3) if i % 7 else None, ["en", "de"][i % 2]) for i in range(55)]
    at, out = f"file://{tmp_path}/vectors", f"file://{tmp_path}/out"
    frame = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    frame.write.parquet(at)
    spark.createDataFrame(documents, DOCS).write.parquet(f"file://{tmp_path}/documents")
    run = lambda name, vectors=at: retrieval_report.retrieval_report(spark, at, vectors, f"file://{tmp_path}/documents", out, name)
    assert run("2026-01-01")["questions"] == 60
    rows = lambda: sorted(map(str, spark.read.schema(retrieval_report.REPORT).parquet(f"{out}/report").collect()))
    before = rows()
    run("2026-01-01")
    assert rows() == before
    expected = brute_report(vectors, documents)
    got = {(r["level"], r["source"], r["lang"]): r for r in spark.read.schema(retrieval_report.REPORT).parquet(f"{out}/report").collect()}
    groups = {}
    for (source, lang), *values in expected.values():
        for key in (("source and language", source, lang), ("source", source, None), ("language", None, lang), ("all", None, None)):
            groups.setdefault(key, []).append(values)
    assert set(got) == set(groups)
    for key, values in groups.items():
        r = got[key]
        assert r["queries"] == len(values) and r["misses"] == sum(v[2] == 0 for v in values) and sum(r["best_bins"]) == len(values)
        for name, k in (("recall_at_k", 0), ("precision_at_k", 1), ("hit_rate", 2), ("mrr", 3)):
            assert math.isclose(r[name], sum(v[k] for v in values) / len(values), abs_tol=1e-8)
        assert r["best_min"] == min(v[4] for v in values) and r["recall_change"] is None

    # A later run over fewer vectors: the change against the run before it, also when an earlier one is repeated after it.
    frame.where("vec_id < 40").write.parquet(f"file://{tmp_path}/fewer")
    run("2026-02-01", f"file://{tmp_path}/fewer")
    run("2026-01-01")
    reports = spark.read.schema(retrieval_report.REPORT).parquet(f"{out}/report").where("level = 'all'")
    by_run = {r["run"]: r for r in reports.collect()}
    assert by_run["2026-01-01"]["recall_change"] is None
    assert math.isclose(by_run["2026-02-01"]["recall_change"], by_run["2026-02-01"]["recall_at_k"] - by_run["2026-01-01"]["recall_at_k"], abs_tol=1e-8)


def test_report_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, label int, embedding array<double>").write.parquet(f"file://{tmp_path}/vectors")
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents")
    at = f"file://{tmp_path}/vectors"
    made = retrieval_report.retrieval_report(spark, at, at, f"file://{tmp_path}/documents", f"file://{tmp_path}/out", "r")
    assert made["questions"] == 0


def test_config_files(spark, tmp_path):
    assert common.read_config(spark, str(ROOT / "jobs/index_documents.json"), index_documents.Config) == index_documents.Config()
    assert common.read_config(spark, str(ROOT / "jobs/retrieval_report.json"), retrieval_report.Config) == retrieval_report.Config()
    (tmp_path / "odd.json").write_text('{"size": 100,\n "colour": 1}')
    with pytest.raises(ValueError, match="colour"):
        common.read_config(spark, str(tmp_path / "odd.json"), index_documents.Config)


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), common.settings(spark, spark__sql__shuffle__partitions="3", spark__foliant__odd="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.foliant.odd", None) is None


@pytest.mark.parametrize(
    "job",
    [
        ["index_documents", "--documents", f"{SMALL}/documents.parque[t]", "--checkpoint", "{at}/checkpoint"],
        ["retrieval_report", "--questions", f"{SMALL}/embeddings.parquet", "--vectors", f"{SMALL}/embeddings.parquet", "--documents", f"{SMALL}/documents.parquet", "--run", "r1"],
    ],
)
def test_command_lines(job, tmp_path):
    args = [a.replace("{at}", str(tmp_path)) for a in job[1:]] + ["--out", f"{tmp_path}/out", "--config", f"jobs/{job[0]}.json"]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job[0]}", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job[0]} read" in done.stderr and "wrote" in done.stderr
    assert any((tmp_path / "out").rglob("*.parquet"))

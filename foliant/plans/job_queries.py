"""The jobs as queries: each runs twice over whole tables into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans import oracle as o
from foliant.plans.queries import Query, _scratch
from jobs import index_documents as index
from jobs import retrieval_report as report

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current chunks of all documents; the second run finds no new file."""
    at = _scratch(spark)
    for _ in range(2):
        index.index_documents(spark, f"{sf_dir}/documents.parque[t]", f"{at}/out", f"{at}/checkpoint")
    made = index.current(spark, f"{at}/out")
    return made.select("doc_id", "source", "lang", "chunk_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "total_chunks", "char_count", "word_count")))


@query
def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all vectors as questions; the second run replaces the first."""
    at = _scratch(spark)
    for _ in range(2):
        report.retrieval_report(spark, f"{sf_dir}/embeddings.parquet", f"{sf_dir}/embeddings.parquet", f"{sf_dir}/documents.parquet", at, "first")
    made = spark.read.schema(report.REPORT).parquet(f"{at}/report")
    return made.withColumn("best_bins", F.array_join("best_bins", ","))


_CHUNKS = o._recursive(512, 50).rsplit(" SELECT doc_id, len(i)", 1)[0].removeprefix("WITH ").replace("FROM documents)", "FROM cleaned)", 1)
_BINS = " || ',' || ".join(f"count(*) FILTER (greatest(0, least(9, floor(best * 10))) = {i})" for i in range(10))
_AVERAGES = ", ".join(f"round(avg({m}::DOUBLE), 9) AS {m}" for m in ("recall_at_k", "precision_at_k", "hit_rate", "mrr"))

SQL: dict[str, str] = {
    "job1_index_documents": f"""WITH cleaned AS (SELECT doc_id, {o._normalized("coalesce(text, '')", markers=False)} AS text FROM documents), {_CHUNKS},
rows AS (SELECT doc_id, unnest(i) AS t, unnest(range(len(i))) AS k, len(i) AS n FROM made),
kinds AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'und') AS lang FROM documents)
SELECT doc_id, source, lang, source || '_chunk_' || k || '_' || substring(md5(t), 1, 8) AS chunk_id, k AS chunk_index, CAST(n AS BIGINT) AS total_chunks, CAST(length(t) AS BIGINT) AS char_count, CAST(len({o._tokens('t')}) AS BIGINT) AS word_count FROM rows JOIN kinds USING (doc_id)""",
    "job2_retrieval_report": f"""WITH {o._METRICS}, best AS (SELECT query_id, round(max(score), 6) AS best FROM hits GROUP BY query_id),
questions AS (SELECT m.*, best, d.source, d.lang FROM metrics m JOIN best USING (query_id) LEFT JOIN documents d ON d.doc_id = m.query_id)
SELECT source, lang, count(*) AS queries, count(*) FILTER (hit_rate = 0) AS misses, {_AVERAGES}, round(avg(best), 6) AS best_avg, min(best) AS best_min, {_BINS} AS best_bins,
  CAST(NULL AS DOUBLE) AS recall_change, 'first' AS run, ['source and language', 'source', 'language', 'all'][1 + grouping(source, lang)] AS level
FROM questions GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""",
}

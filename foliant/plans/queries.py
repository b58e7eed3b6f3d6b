"""Registered queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.engine import tenants
from foliant.functions import html, sentences, terms, text
from foliant.functions.vectors import cosine
from foliant.operators import chunking, evaluation, generation, knn, metadata, ranking
from foliant.operators import generation_metrics as gen
from foliant.operators import retrieval_metrics as ret
from foliant.operators.collection import Store
from foliant.operators.metric_report import partials, report
from foliant.operators.neighbours import with_previous, with_running_sum
from foliant.operators.pruned import PrunedIndex
from foliant.providers.embedding import HashedTerms
from foliant.sources import files
from foliant.streaming.ingest import log_metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a temporary one only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _digest(items: Column) -> Column:
    """A short stand-in for a long array of strings: an md5 over its elements."""
    return F.md5(F.array_join(items, "\u001f").cast("binary"))


# -- vectors ------------------------------------------------------------------------------------------


def _nearest(spark: SparkSession, sf_dir: str, where: dict | None = None, k: int = 5) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), vectors, k, where, exclude_self=True)


def _as_hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector."""
    return _as_hits(_nearest(spark, sf_dir))


@query
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among vectors of one label; the filter reaches the scan."""
    return _as_hits(_nearest(spark, sf_dir, {"label": 3}))


@query
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector, from the rings of vectors that can hold them."""
    vectors = _table(spark, sf_dir, "embeddings")
    index = PrunedIndex(spark, _scratch(spark))
    index.build(vectors, vectors.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1)
    return _as_hits(index.search(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 5, exclude_self=True))


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of each vector with the next of its label, by expressions."""
    rows = with_previous(_table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", ["embedding"])
    return rows.where("previous is not null").select("vec_id", F.round(cosine(F.col("previous.embedding"), F.col("embedding")), 6).alias("similarity"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ranking.retrieved(_nearest(spark, sf_dir), docs.select(F.col("doc_id").alias("vec_id"), "text", "source"))


@query
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and sources of every vector as a query: search, text join, ordered assembly."""
    made = generation.contexts(_retrieved(spark, sf_dir))
    names = F.array_distinct(F.transform("docs", lambda d: F.coalesce(d["source"], F.lit(ranking.UNKNOWN_SOURCE))))
    return made.select("query_id", F.length("context").cast("long").alias("context_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"), F.array_join(names, ",").alias("sources"))


@query
def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.ordered_sources(_retrieved(spark, sf_dir))
    return found.select("query_id", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("long").alias("n"))


@query
def semantic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the vectors of a label: a new one begins where neighbours are less alike than a threshold."""
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    before = with_previous(rows, "label", "vec_id", ["embedding"])
    cut = F.coalesce(F.round(cosine(F.col("previous.embedding"), F.col("embedding")), 9) < 0.0, F.lit(False))
    seg = with_running_sum(before.select("label", "vec_id", cut.cast("int").alias("cut")), "label", "vec_id", "cut", "segment")
    return seg.groupBy("label", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


# -- retrieval metrics and ranking --------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Metrics of rankings (query_id, rank, id), by cosine if none are given; relevant are the other vectors of the query's label."""
    labels = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    if ranked is None:
        ranked = _nearest(spark, sf_dir).select("query_id", "rank", F.col("vec_id").alias("id"))
    own, other = (labels.select(F.col("vec_id").alias(x), F.col("label").alias(f"_{x}")) for x in ("query_id", "id"))
    flagged = ranked.join(own, "query_id").join(other, "id", "left").withColumn("relevant", F.col("_query_id") == F.col("_id"))
    size = labels.groupBy(F.col("label").alias("_query_id")).agg((F.count(F.lit(1)) - 1).alias("num_relevant"))
    return ret.flagged_metrics(flagged, own.join(size, "_query_id").select("query_id", "num_relevant"), k)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_judged(spark, sf_dir), *ret.METRICS)


@query
def retrieval_metrics_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ret.averages(_judged(spark, sf_dir)), *ret.METRICS)


@query
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ret.score_stats(_nearest(spark, sf_dir)), "avg_score", "min_score", "max_score", "score_std")


@query
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by tenant and source, tenant, source and in total, merged from the partial results of two halves of the questions."""
    found = _nearest(spark, sf_dir)
    best = found.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("score"))
    tenant = F.concat(F.lit("rag_tenant"), F.pmod("label", F.lit(3)).cast("string"))
    own = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), tenant.alias("tenant"))
    source = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "source")
    judged = _judged(spark, sf_dir, found.select("query_id", "rank", F.col("vec_id").alias("id")))
    rows = judged.join(best, "query_id").join(own, "query_id").join(source, "query_id", "left")
    # written once: a half's filter would go down to the search, which each half would then do in full
    at = _scratch(spark)
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    halves = [partials(rows.where(F.pmod("query_id", F.lit(2)) == i)) for i in (0, 1)]
    return _rounded(report(halves[0].unionByName(halves[1])).drop("quantiles"), *ret.METRICS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved documents with the query's own text as the question; its key terms are made once, not for each document."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), terms.key_terms("text").alias("asked"))
    return _retrieved(spark, sf_dir).join(docs, "query_id")


def _lexical() -> Column:
    return ranking.terms_score(F.col("asked"), F.col("content"))


@query
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.reranked(_asked(spark, sf_dir), top_k=3, min_score=0.05, score=_lexical())
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("rerank_score", 9).alias("rerank_score"))


@query
def rerank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _asked(spark, sf_dir)
    found = ret.rerank_impact(docs.select("query_id", "rank", "id"), ranking.reranked(docs, top_k=3, score=_lexical()).select("query_id", "rank", "id"))
    return found.withColumn("overlap_ratio", F.round("overlap_ratio", 9))


@query
def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two documents from responses in several shapes, whose figures are the length and the place of each turn."""
    a, b = (F.length(F.coalesce("text", F.lit(""))) % 13).cast("string"), F.concat((F.col("turn") % 10).cast("string"), F.lit(".5"))
    shapes = [
        F.concat(F.lit('Scores: {"1": '), a, F.lit(', "2": '), b, F.lit("}")),
        F.concat(F.lit("Document 1: "), a, F.lit("\nDocument 2: "), b),
        F.concat(F.lit("[Document 2]: "), b, F.lit(" and [Document 1]: "), a),
        F.concat(F.lit('1 = '), a, F.lit(', 3 = 4')),
        F.lit("neither is of use"),
    ]
    response = F.element_at(F.array(*shapes), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    made = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(ranking.parsed_scores(response, F.lit(2))).alias("_p", "score"))
    return made.select("conv_id", "turn", (F.col("_p") + 1).cast("long").alias("document"), F.round("score", 9).alias("score"))


# -- text ---------------------------------------------------------------------------------------------


def _text_query(items: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _table(spark, sf_dir, "documents").select("doc_id", items(F.col("text")).alias("_i"))
        return made.select("doc_id", F.size("_i").cast("long").alias("n"), _digest(F.col("_i")).alias("items_md5"))

    return run


QUERIES |= {
    "key_terms": _text_query(lambda t: F.array_sort(terms.key_terms(t))),
    "bigrams": _text_query(lambda t: F.array_sort(terms.ngrams(t))),
    "sentences": _text_query(sentences.sentences),
    "pattern_sentences": _text_query(sentences.pattern_sentences),
    "sentence_chunks": _text_query(lambda t: chunking.sentence_chunks(t, 512, 50)),
    "fallback_chunks": _text_query(chunking.fallback_chunks),
    "recursive_chunks": _text_query(lambda t: chunking.recursive_chunks(t, 512, 50)),
    "forced_chunks": _text_query(lambda t: chunking.forced(t, 512)),
    "chunk_overlap": _text_query(lambda t: chunking.with_overlap(chunking.forced(t, 512), 50)),
    "paragraph_starts": _text_query(lambda t: F.transform(text.paragraph_starts(F.replace(t, F.lit("\n"), F.lit("\n\n"))), lambda x: x.cast("string"))),
}


def _document_query(columns: Callable[[], dict[str, Column]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in columns().items()))

    return run


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def _with_markers() -> Column:
    return F.concat(F.col("text"), F.lit("\nPage 3\n[Page 12]\n 17 \np. 4\nthe end\n"))


QUERIES |= {
    "normalize_text": _document_query(lambda: {"text_md5": _md5(text.normalized("text")), "chars": F.length(text.normalized("text")).cast("long")}),
    "page_markers": _document_query(lambda: {"text_md5": _md5(text.normalized(_with_markers()))}),
    "drop_repeated_lines": _document_query(lambda: {"text_md5": _md5(text.without_repeated_lines(F.col("text")))}),
    "ocr_repair": _document_query(lambda: {"text_md5": _md5(text.repaired_ocr(F.col("text")))}),
    "answer_length": _document_query(lambda: {n: terms.text_length("text")[n] for n in ("chars", "words", "sentences")}),
}


@query
def reading_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", sentences.reading_complexity("text", None).alias("_c"))
    return _rounded(rows.select("doc_id", "_c.*"), "avg_word_length", "avg_sentence_length", "long_word_ratio", "complexity_score")


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", chunking.with_offsets(F.col("text"), chunking.forced(F.col("text"), 512)).alias("_c"))
    return rows.select("doc_id", F.inline("_c")).select("doc_id", F.col("index").cast("long").alias("index"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@query
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic strategy with the local embedding."""
    made = chunking.semantic_table(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", HashedTerms().embed_all)
    return made.select("doc_id", F.size("_chunks").cast("long").alias("n"), _digest(F.col("_chunks")).alias("items_md5"))


@query
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local embedding of conversation turns, as the sum of components weighted by their place."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", HashedTerms(64).embed(F.col("text")).alias("_v"))
    total = F.aggregate(F.transform("_v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.round(total, 4).alias("weighted"))


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of all documents with their ids and counts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string")).alias("file_path"))
    rows = docs.select("doc_id", "source", "file_path", F.posexplode(chunking.forced(F.col("text"), 512)).alias("chunk_index", "chunk_text"))
    made = metadata.enriched(rows)
    return made.select("chunk_id", "document_id", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"))


@query
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string")).alias("file_path"))
    rows = docs.select("source", "file_path", F.posexplode(chunking.forced(F.col("text"), 512)).alias("chunk_index", "chunk_text"))
    return metadata.document_totals(metadata.enriched(rows))


@query
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File, reader and given metadata merged, a later one winning, and cleaned."""
    docs = _table(spark, sf_dir, "documents")
    file = F.create_map(F.lit("source"), F.col("source"), F.lit("type"), F.lit("text"), F.lit("title"), F.lit(""))
    given = F.create_map(F.lit("type"), F.col("lang"), F.lit("size"), F.col("n_chars").cast("string"))
    merged = metadata.cleaned(metadata.merged(file, given))
    return docs.select("doc_id", merged["source"].alias("source"), merged["type"].alias("type"), F.size(merged).cast("long").alias("n"))


# -- sources ------------------------------------------------------------------------------------------


@query
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.title("html").alias("title"))


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.html_documents(_table(spark, sf_dir, "pages"))
    return made.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("char_count").cast("long").alias("chars"))


@query
def file_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader that would take each page's address as a file name, under four extensions."""
    kinds = (".TXT", ".md", ".html", ".docx", ".exe")
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("page_id", F.lit(len(kinds))) + 1).cast("int"))).alias("path"))
    return rows.select("page_id", files.extension(F.col("path")).alias("extension"), files.reader_for(F.col("path")).alias("reader"))


@query
def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source by the tenant its key belongs to."""
    known = tenants(spark, "src0:acme, src1:beta:two,src2:acme,bad,src0:zeta")
    docs = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("api_key")).agg(F.count(F.lit(1)).alias("n"))
    return docs.join(known, "api_key").groupBy("tenant").agg(F.sum("n").alias("n"))


# -- answers ------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers; the text of the turn before stands for the context."""
    turns = _table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("context", F.lag("text").over(before)).where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.col("text").alias("answer"), "context")


@query
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gen.answer_metrics(_answers(spark, sf_dir))
    return _rounded(made, *gen.METRICS).drop("answer", "context")


@query
def generation_metrics_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gen.averages(gen.answer_metrics(_answers(spark, sf_dir)))
    return _rounded(made, *(c for c in made.columns if c.startswith("avg")))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _asked(spark, sf_dir).select("query_id", "rank", "id", "content", "score")
    answers = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("question"), F.col("text").alias("answer"))
    runs = answers.join(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id")), "query_id")
    return evaluation.evaluate(runs, docs, judged=_judged(spark, sf_dir, docs.select("query_id", "rank", "id")))


@query
def evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = evaluation.flattened(_evaluated(spark, sf_dir)).drop("question")
    return _rounded(flat, *(c for c in flat.columns if c != "query_id"))


@query
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluation.summary(_evaluated(spark, sf_dir))
    return _rounded(made, *(c for c in made.columns if c.startswith("avg")))


# -- collections --------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("doc_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection after all points, and then those of odd labels with another text, were merged into it."""
    store, points = Store(spark, _scratch(spark)), _points(spark, sf_dir)
    store.create("c", 64)
    store.upsert("c", points)
    store.upsert("c", points.where("cast(metadata['label'] as int) % 2 = 1").withColumn("text", F.concat("text", F.lit("!"))))
    return store.read("c").select("doc_id", "text", F.col("metadata")["label"].alias("label"))


@query
def delete_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, points = Store(spark, _scratch(spark)), _points(spark, sf_dir)
    store.create("c", 64)
    store.upsert("c", points, mode="append")
    store.delete("c", points.where("metadata['label'] = '3'").select("doc_id"))
    return store.read("c").groupBy(F.col("metadata")["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, _scratch(spark))
    store.create("c", 64)
    store.upsert("c", _points(spark, sf_dir))
    return store.info("c")


@query
def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the stored points of one label."""
    store = Store(spark, _scratch(spark))
    store.create("c", 64)
    store.upsert("c", _points(spark, sf_dir))
    asked = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    found = store.search("c", asked, 3, {"label": 2})
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query-log metrics of the streaming module, over the whole table as a batch."""
    made = log_metrics(_table(spark, sf_dir, "events"))
    return made.select("window_start", "event_type", "n", F.round("total", 6).alias("total"), "most")

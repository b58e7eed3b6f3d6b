"""The engine: documents to collections, questions to answers, both as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.functions.text import is_blank
from foliant.operators import bucketed, chunking, collection, evaluation, generation, metadata, ranking  # noqa: F401
from foliant.operators.collection import tenant_collection
from foliant.operators.embedding_table import EmbeddingTable
from foliant.providers import answering, embedding
from foliant.sources import files

#: A small corpus for demonstrations and for questions without any collection.
DEMO = (
    ("demo_spark", "Spark plans a query as a tree of operators and runs it in stages on many executors.", "spark.md"),
    ("demo_parquet", "Parquet keeps each column apart, with statistics that let a reader skip what a filter excludes.", "parquet.md"),
    ("demo_vectors", "A vector search compares the embedding of a question with the embeddings of chunks by cosine.", "vectors.md"),
    ("demo_chunks", "Long documents are cut into chunks that overlap, so that a sentence at a border is not lost.", "chunks.md"),
    ("demo_rerank", "A reranker judges a few candidates again and keeps the best of them for the answer.", "rerank.md"),
    ("demo_metrics", "Recall counts the relevant documents that were found, and precision the found ones that are relevant.", "metrics.md"),
)


class Engine:
    """Holds settings, providers and the store; arguments win over settings."""

    def __init__(self, spark: SparkSession, root: str | None = None, embedder=None, answerer=None, scorer=None, recognizer: files.PageParser | None = None, external: evaluation.Client | None = None, **settings) -> None:
        self.spark = spark
        self.settings = Settings.of(spark, store_root=root, **settings)
        s = self.settings
        self.embedder = embedder or embedding.create(s.embedding_provider, dimension=s.dimension)
        self.vectors = EmbeddingTable(spark, s.embedding_table, self.embedder) if s.embedding_table else None
        self.answerer = answerer or answering.create_answer(s.answer_provider)
        self.scorer = scorer or (answering.create_scorer(s.reranker) if s.reranking else None)
        self.recognizer = recognizer if s.ocr else None
        self.external = external
        if not s.store_root:
            raise ValueError("a root for collections is needed: root=... or foliant.store_root")
        self.store = collection.create(s.store_provider, spark, s.store_root)
        self.store.create(s.collection, self.embedder.dimension())
        if s.seed_demo and self.store.count(s.collection) == 0:
            self.ingest(self.demo())

    def demo(self) -> DataFrame:
        return self.spark.createDataFrame(list(DEMO), "id string, text string, source string").select("text", "source")

    # -- documents

    def load(self, path: str, parser: files.PageParser | None = None) -> DataFrame:
        """(text, source, file_path, status) of the files under ``path``; what cannot be read has a status and no text."""
        return self.loaded(files.read_binary(self.spark, path), parser)

    def loaded(self, found: DataFrame, parser: files.PageParser | None = None) -> DataFrame:
        """``load`` of files that were found already (path, content), as by a stream."""
        found = found.withColumn("_reader", files.reader_for(F.col("path")))
        parts = [
            files.text_documents(found.where("_reader = 'text'")).select("path", "text", F.lit(None).cast("string").alias("error")),
            files.html_documents(found.where("_reader = 'html'").withColumn("html", files.decoded(F.col("content")))).select("path", "text", F.lit(None).cast("string").alias("error")),
            files.docx_documents(found.where("_reader = 'docx'")).select("path", "text", "error"),
            found.where("_reader is null").select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported file type").alias("error")),
        ]
        pdf = found.where("_reader = 'pdf'")
        if parser is None:
            parts.append(pdf.select("path", F.lit(None).cast("string").alias("text"), F.lit("no PDF parser is configured").alias("error")))
        else:
            parts.append(files.pdf_documents(pdf, parser, recognizer=self.recognizer).select("path", "text", "error"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("text", F.element_at(F.split("path", "/"), -1).alias("source"), F.col("path").alias("file_path"), F.coalesce("error", F.when(is_blank("text"), F.lit("no text"))).alias("error"))

    def chunks(self, docs: DataFrame) -> DataFrame:
        """Chunk rows of documents (text, source, and file_path if there is one) with ids, counts and vectors."""
        s = self.settings
        rows = docs if "file_path" in docs.columns else docs.withColumn("file_path", F.lit(""))
        made = chunking.chunk_rows(
            rows.where(~is_blank("text")).select("text", "source", "file_path"),
            strategy=s.chunking, size=s.chunk_size, overlap=s.chunk_overlap, embed_all=self.embedder.embed_all, by_table=self.vectors and self.vectors.semantic, semantic=chunking.Semantic(s.similarity, s.chunk_min, s.chunk_max),
        )
        made = metadata.enriched(made)
        if self.vectors is None:
            # In Arrow batches: expressions would be interpreted once for each word and each component.
            return made.withColumn("embedding", self.embedder.embed_all(F.array("chunk_text"))[0])
        columns = made.columns
        named = self.store.staged(made).withColumn("text", F.col("chunk_text"))
        return self.vectors.attached(named).select(*columns, F.col("vector").alias("embedding"))

    def ingest(self, docs: DataFrame, tenant: str | None = None, mode: str = "merge") -> DataFrame:
        """Chunks, embeds and stores documents; one row for each with success, chunk_count, document_id and error.

        Chunks and their vectors are made once. A chunk without a vector, as after failed calls of a remote provider, is not
        stored, and its document has an error.
        """
        name = tenant_collection(tenant) if tenant else self.settings.collection
        self.store.create(name, self.embedder.dimension())
        made = self.store.staged(self.chunks(docs))
        keep = ("source", "file_path", "document_id", "chunk_index", "total_chunks", "char_count", "word_count", "ingested_at", "system")
        kept = metadata.typed(made, *keep) if self.store.typed else metadata.storable(made, *keep)
        points = made.where("embedding is not null").select(F.col("chunk_id").alias("doc_id"), F.col("document_id").alias("parent"), F.col("chunk_text").alias("text"), "embedding", kept.alias("metadata"))
        if not self.store.typed:
            points = points.drop("parent")
        # The bucketed store is told that the points are read from a table, so that it does not write them a second time.
        stored = self.store.upsert(name, points, mode, **({"stored": True} if isinstance(self.store, bucketed.BucketedStore) else {}))
        # by source and path themselves: documents may share an id, which holds 32 bits of a digest
        counts = made.groupBy(F.col("source").alias("_source"), F.col("file_path").alias("_path")).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_if(F.col("embedding").isNull()).alias("_lost"))
        counts = self.store.staged(counts)
        if isinstance(self.store, collection.Store):
            self.store.unstage(made)
        path = F.col("file_path") if "file_path" in docs.columns else F.lit("")
        error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
        rows = docs.select(F.col("source").alias("document_name"), path.alias("_at"), metadata.document_id(F.col("source"), path).alias("document_id"), error.alias("_e"), is_blank("text").alias("_b"))
        rows = rows.join(counts, F.col("document_name").eqNullSafe(F.col("_source")) & F.col("_at").eqNullSafe(F.col("_path")), "left")
        lost = F.when(F.col("_lost") > 0, F.concat(F.col("_lost").cast("string"), F.lit(" chunks have no vector")))
        problem = F.coalesce("_e", F.when(F.col("_b"), F.lit("no text")), lost) if stored else F.lit("the collection refused the vectors")
        return rows.select("document_name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "document_id", problem.alias("error"), problem.isNull().alias("success"))

    # -- questions

    def retrieve(self, questions: DataFrame, tenant: str | None = None, where: dict | None = None) -> DataFrame:
        """(query_id, question, rank, id, content, source, score) for questions (query_id, question) that are neither blank nor too long.

        Questions are embedded once: their vectors are written before they are used.
        """
        s = self.settings
        name = tenant_collection(tenant) if tenant else s.collection
        if s.demo_fallback and self.store.read(name).isEmpty():
            return self._fixed_hits(questions)
        asked = self.store.staged(questions.where(self._askable()).select("query_id", "question").withColumn("embedding", self.embedder.embed(F.col("question"))))
        k = ranking.width(self.scorer is not None, s.retrieval_top_k, s.final_top_k)
        hits = self.store.search(name, asked.select("query_id", "embedding"), k, where)
        found = hits.join(questions.select("query_id", "question"), "query_id").select("query_id", "question", "rank", "id", F.col("text").alias("content"), F.col("metadata")["source"].alias("source"), "score")
        if s.demo_fallback:
            # A question without a vector, as after failed calls, gets the fixed hits too.
            found = found.unionByName(self._fixed_hits(asked.where("embedding is null")))
        return found

    def _askable(self) -> Column:
        return ~is_blank("question") & (F.length("question") <= self.settings.question_chars)

    def _fixed_hits(self, questions: DataFrame) -> DataFrame:
        """The first demonstration documents for every question that is not blank, for trying things out without a corpus."""
        hits = F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.lit(d[0]).alias("id"), F.lit(d[1]).alias("content"), F.lit(d[2]).alias("source"), F.lit(round(0.9 - 0.1 * i, 1)).alias("score")) for i, d in enumerate(DEMO[:3])))
        return questions.where(self._askable()).select("query_id", "question", F.inline(hits))

    def ask(self, questions: DataFrame, tenant: str | None = None, where: dict | None = None) -> DataFrame:
        """(query_id, question, answer, sources, docs): one row for each question; a blank or overlong one gets a fixed answer and no sources."""
        s = self.settings
        docs = self.retrieve(questions, tenant, where)
        if self.scorer is not None:
            docs = self.scorer.rerank(docs, s.final_top_k, s.rerank_min_score)
        else:
            docs = docs.withColumn("rerank_score", F.lit(None).cast("double"))
        items = F.array_sort(F.collect_list(F.struct("rank", "id", "content", "source", "score", "rerank_score")))
        found = docs.groupBy("query_id").agg(items.alias("docs"))
        rows = questions.select("query_id", "question").join(found, "query_id", "left")
        rows = rows.withColumn("docs", F.coalesce("docs", F.array().cast(found.schema["docs"].dataType)))
        answer = generation.with_fallback(self.answerer.answer(F.col("question"), F.col("docs")), F.col("question"), F.col("docs"))
        names = F.array_distinct(F.transform("docs", lambda d: F.coalesce(F.nullif(d["source"], F.lit("")), F.lit(ranking.UNKNOWN_SOURCE))))
        return rows.select("query_id", "question", F.when(is_blank("question"), F.lit(generation.BLANK_ANSWER)).when(~self._askable(), F.lit(f"The question is longer than {s.question_chars} characters.")).otherwise(answer).alias("answer"), names.alias("sources"), "docs")

    def evaluate(self, answers: DataFrame, truth: DataFrame | None = None) -> DataFrame:
        """Metrics of what ``ask`` returned, one row for each question; logged and kept if the settings say so."""
        s = self.settings
        docs = answers.select("query_id", F.inline("docs"))
        made = evaluation.evaluate(answers, docs, truth, evaluation.Evaluation(s.evaluation, s.evaluation_k, s.external_metrics), client=self.external)
        if s.evaluation and (s.evaluation_history or s.evaluation_log):
            made = self.store.staged(made)
        if s.evaluation and s.evaluation_history:
            self.history().add(made)
        if s.evaluation and s.evaluation_log:
            evaluation.log_summary(made)
        return made

    def history(self) -> evaluation.History:
        return evaluation.History(f"{self.settings.store_root.rstrip('/')}/evaluations")

    # -- state

    def drop_tenant(self, tenant: str) -> bool:
        return self.store.drop(tenant_collection(tenant))

    def describe(self) -> dict:
        return self.settings.described() | {"embedding": self.embedder.name, "answers": self.answerer.name, "reranker": self.scorer.name if self.scorer else None, "problems": self.settings.problems()}

    def health(self) -> dict:
        return {"status": "healthy", "collection": self.settings.collection, "points": self.store.count(self.settings.collection)}


def tenants(spark: SparkSession, keys: str) -> DataFrame:
    """(api_key, tenant) of a list ``key:tenant,key:tenant``; the tenant begins after the first colon, and a later key wins."""
    parts = [p.strip() for p in keys.split(",") if ":" in p]
    pairs = dict((k.strip(), t.strip()) for k, _, t in (p.partition(":") for p in parts) if k.strip() and t.strip())
    return spark.createDataFrame(sorted(pairs.items()), "api_key string, tenant string")

"""Keeps chunks of a growing folder of documents: each run takes the files that are new since the last one.

    python -m jobs.index_documents --documents PATH --out PATH --checkpoint PATH [--config PATH]

Documents (doc_id, text, source, lang) are normalized, cut into chunks and written to OUT/chunks, with one row for
each document in OUT/documents; both have a partition for each micro-batch and, below it, each language. The stream's checkpoint knows
which files were taken. A micro-batch that is repeated after a failure has the same number and replaces what its first
try has left, so that nothing is there twice. A document that comes again with another text gets new chunks, and ``current``
shows the newest; one that comes again unchanged is not cut again. Nothing is deleted: the older chunks are history.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import Normalization, normalized
from foliant.operators import chunking, metadata
from jobs.common import overwrite_partitions, read_config, read_written, session, settings

log = logging.getLogger("jobs.index_documents")

INPUT = ("doc_id", "text", "source", "lang")
CHUNKS = "doc_id bigint, source string, chunk_id string, chunk_index int, total_chunks int, chunk_text string, char_count int, word_count int, batch bigint, lang string"
DOCUMENTS = "doc_id bigint, source string, text_md5 string, n_chunks int, error string, batch bigint, lang string"


@dataclass(frozen=True)
class Config:
    strategy: str = "recursive"
    size: int = 512
    overlap: int = 50
    #: Files of one micro-batch at most.
    files_per_batch: int = 64
    #: About as many documents go into one file of a partition.
    rows_per_file: int = 200_000


def prepared(docs: DataFrame, how: Config) -> DataFrame:
    """(doc_id, source, lang, text_md5, clean) of the documents of a micro-batch, one row for each id.

    Rows without an id are left out. Of rows that repeat an id in one micro-batch the one with the last text, source and
    language in order wins, whatever order they come in. A null source is ``unknown``, a null language ``und``.
    """
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("und")).alias("lang")).alias("_d"),
    )
    last = rows.groupBy("doc_id").agg(F.max("_d").alias("_d"))
    return last.select("doc_id", "_d.source", "_d.lang", F.md5(F.col("_d.text").cast("binary")).alias("text_md5"), normalized(F.col("_d.text"), Normalization(page_markers=False)).alias("clean"))


def newest(documents: DataFrame) -> DataFrame:
    """The rows of the newest micro-batch of each document."""
    last = documents.groupBy("doc_id").agg(F.max_by(F.struct(*documents.columns), "batch").alias("_d"))
    return last.select("_d.*")


def take(batch: DataFrame, number: int, out: str, how: Config) -> None:
    """Writes the chunks and the states of the documents of a micro-batch that are new or changed."""
    spark = batch.sparkSession
    docs = prepared(batch, how)
    # What this micro-batch wrote at a first try is not looked at: it is replaced.
    known = newest(read_written(spark, f"{out}/documents", DOCUMENTS, f"batch < {number}")).select("doc_id", "source", "lang", "text_md5", F.lit(True).alias("_known"))
    fresh = docs.join(known, ["doc_id", "source", "lang", "text_md5"], "left_anti")
    made = chunking.chunk_rows(fresh, text="clean", strategy=how.strategy, size=how.size, overlap=how.overlap)
    made = metadata.enriched(made.withColumn("file_path", F.col("doc_id").cast("string"))).withColumn("batch", F.lit(number).cast("long"))
    chunks = [c.split()[0] for c in CHUNKS.split(", ")]
    overwrite_partitions(made.select(*chunks), f"{out}/chunks", "batch", "lang")
    counts = read_written(spark, f"{out}/chunks", CHUNKS, f"batch = {number}").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    states = fresh.join(counts, "doc_id", "left").select(
        "doc_id", "source", "text_md5", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("clean") == "", "no text").alias("error"), F.lit(number).cast("long").alias("batch"), "lang"
    )
    overwrite_partitions(states, f"{out}/documents", "batch", "lang")


def index_documents(spark: SparkSession, documents: str, out: str, checkpoint: str, how: Config = Config()) -> dict[str, int]:
    """Takes all files under ``documents`` that the checkpoint does not know, and ends; what was read and written is logged and returned."""
    out = out.rstrip("/")
    kinds = spark.read.parquet(documents).select(*INPUT).schema
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", how.files_per_batch).parquet(documents)
    taken: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        take(batch, number, out, how)
        taken.append(number)

    # The states are small beside the texts, so that a join picks their side by its size; files hold many rows.
    with settings(spark, spark__sql__files__maxRecordsPerFile=str(how.rows_per_file)):
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    report = {"batches": len(taken), "documents": 0, "chunks": 0}
    if taken:
        span = f"batch between {min(taken)} and {max(taken)}"
        report["documents"] = read_written(spark, f"{out}/documents", DOCUMENTS, span).count()
        report["chunks"] = read_written(spark, f"{out}/chunks", CHUNKS, span).count()
    log.info("read %s: %d micro-batches; wrote %d documents and %d chunks to %s", documents, report["batches"], report["documents"], report["chunks"], out)
    return report


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the newest version of each document."""
    out = out.rstrip("/")
    last = newest(read_written(spark, f"{out}/documents", DOCUMENTS)).where("n_chunks > 0").select("doc_id", "batch")
    return read_written(spark, f"{out}/chunks", CHUNKS).join(last, ["doc_id", "batch"])


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = session("index_documents")
    try:
        how = read_config(spark, given.config, Config) if given.config else Config()
        index_documents(spark, given.documents, given.out, given.checkpoint, how)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

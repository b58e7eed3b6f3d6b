"""Continuous ingestion and metrics of a query log, with the same expressions as the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.engine import Engine
from foliant.operators.chunking import chunk_rows
from foliant.operators.metadata import chunk_id


def chunk_stream(docs: DataFrame, **how) -> DataFrame:
    """A stream of documents (source, text, ...) as chunk rows with their ids."""
    return chunk_rows(docs, **how).withColumn("chunk_id", chunk_id(F.col("source"), F.col("chunk_index"), F.col("chunk_text")))


def deduplicated(chunks: DataFrame, time: str, within: str = "1 hour") -> DataFrame:
    """Chunks of inputs that may arrive more than once: repeats within the watermark are dropped, and so is their state."""
    return chunks.withWatermark(time, within).dropDuplicatesWithinWatermark(["chunk_id"])


def start(chunks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs ``sink`` on every micro-batch; ``once`` stops after what is there."""
    writer = chunks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files under ``path`` as they come: (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest_stream(engine: Engine, docs: DataFrame, checkpoint: str, statuses: str, tenant: str | None = None, mode: str = "replace", once: bool = True, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Brings a stream of documents into a collection; ``prepare`` makes documents of its rows, as ``engine.loaded`` does of files.

    Ids of points and documents follow from their contents and places, and a micro-batch is merged into the collection, so that one that is
    repeated after a failure, or all of them by a new checkpoint, leave the same points. The status of each document is written to
    ``statuses``, in a partition of the micro-batch, which a repeat replaces. With ``mode`` "replace", which needs the bucketed store,
    a document that comes again loses the chunks it no longer has.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        made = engine.ingest(prepare(rows) if prepare else rows, tenant, mode)
        made.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(statuses)

    return start(docs, sink, checkpoint, once)


def log_metrics(events: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and values of a query log (ts, event_type, value) over tumbling windows, late rows within the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    per = rows.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n", "total", "most")

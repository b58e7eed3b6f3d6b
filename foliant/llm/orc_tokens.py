"""A token file format on ORC: documents in ascending id order, integer run-length encoded ids.

A folder holds one ORC file for each range of document ids, in the order of the file names. Each row is a
document: part (number of the range), start (ids before it in the range), doc_id, n_tokens, and ids. Files
have stripes that tasks read in parallel, row indexes with minima and maxima, and a Bloom filter on doc_id,
so that reading single documents skips stripes and row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import pick, small_batches, trim
from foliant.llm.token_ids import encoder

SCHEMA = "part int, start bigint, doc_id bigint, n_tokens bigint, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Bytes of text in one range, that is in one file.
RANGE_BYTES = 256 << 20
OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text), appends ``end_id``, and writes the format.

    The rows are dealt by ranges of doc_id and sorted there; rows with one doc_id follow each other by a hash
    of their text and may fill several ranges, equal rows too; a null doc_id comes first, a null text is the empty text, and
    an empty table gives a folder without rows. Ids are made after the exchange, which therefore carries texts, not ids.
    ``partitions`` is the number of ranges; if None, as many as leave about ``RANGE_BYTES`` of text to each, and
    not fewer than the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions
    if n is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    keyed = rows.select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_hash", "_place").sortWithinPartitions("doc_id", "_hash", "_place").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, machine = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text"):
            ids = [x + end for x in machine.encode(batch.column("text").to_pylist())]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32, copy=False))
            yield pa.record_batch(
                [
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + offsets[:-1]),
                    batch.column("doc_id"),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                ],
                schema=_ARROW,
            )
            start += int(offsets[-1])
        trim()

    ordered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written: (part, start, doc_id, n_tokens, ids); filters on doc_id reach the file indexes."""
    return spark.read.schema(SCHEMA).orc(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all earlier ranges. Reads two columns; one row per range, of which there are few."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("before"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files; start counts the ids of all documents before."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("part"), batch.column("start"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["part", "start", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).mapInArrow(crc, "part int, start bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(positions(spark, path), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

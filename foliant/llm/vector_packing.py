"""Packing token pieces into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths).
Pieces are placed longest first, each into the open sequence that is best by a weighted score among those in
which it fits under every capacity.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick, small_batches, trim
from foliant.llm.token_ids import encoder


@dataclass(frozen=True)
class Capacity:
    """``score``: "norm" takes the least weighted norm of what is left, "dot" the greatest weighted product of need and room."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"
    #: Documents whose first pieces one task packs on average.
    group: int = 8192


_DOCUMENT = "doc_id bigint, row bigint, head bigint, crcs array<bigint>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("head", pa.int64()), ("crcs", pa.list_(pa.int64()))])


def cut_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, row, head, crcs): how the ids of every whole text and ``end_id`` are cut, one row for each row of ``docs``.

    A document of ``most`` ids or fewer is one piece; of longer ones all pieces but the first, of ``head`` ids, are full.
    crcs has the crc32 of each piece's ids. A null or empty text is the end id alone; rows with a null or repeated
    doc_id are documents of their own. ``row`` hashes the id, the ids of the text, the task, and how many equal rows
    the task had before: whatever the order of a task's rows, a repeat after a lost executor gives the same numbers.
    An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text"):
            rows, heads, crcs = [], [], []
            docs = batch.column("doc_id").to_pylist()
            for doc, data in zip(docs, machine.encode(batch.column("text").to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                own = xxhash.xxh3_64_intdigest(data, 0 if doc is None else (2 * doc + 1) & ((1 << 64) - 1))
                seen[own] = before = seen.get(own, -1) + 1
                rows.append(xxhash.xxh3_64_intdigest(struct.pack("<Qqq", own, task, before)) - (1 << 63))
                cuts = [0, *range(n % most or most, n, most), n]
                heads.append(cuts[1])
                view = memoryview(data)
                crcs.append([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((docs, rows, heads, crcs), _ARROW, strict=True)], schema=_ARROW)
        trim()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _DOCUMENT)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Deterministic: ties go to the earlier piece and the earlier bin."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(capacity.weights)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    order = np.argsort(-lengths, kind="stable")
    least = float(lengths.min())
    smallest = np.array([least, 1.0, least * least])
    room, ids, used, made = np.empty((len(lengths), 3)), np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    opened = 0
    for i in order.tolist():
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        if (need > full).any():
            raise ValueError(f"a piece of {int(n)} tokens fits in no sequence")
        live = room[:made]
        fits = (live[:, 0] >= need[0]) & (live[:, 1] >= need[1]) & (live[:, 2] >= need[2])
        at = np.flatnonzero(fits)
        if len(at):
            left = (live[at] - need) / full
            score = (left * left) @ weights if capacity.score == "norm" else -(((need / full) * (live[at] / full)) @ weights)
            k = int(at[np.argmin(score)])
        else:
            k, made = made, made + 1
            room[k], ids[k] = full, opened
            opened += 1
        bins[i], offsets[i] = ids[k], used[ids[k]]
        used[ids[k]] += int(n)
        room[k] -= need
        if (room[k] < smallest).any():  # closed: the last bin takes its place
            made -= 1
            room[k], ids[k] = room[made], ids[made]
    return bins, offsets


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``cut_documents``.

    Texts are encoded once, and what is exchanged is one row for each document. These are dealt into groups of about
    ``capacity.group`` by a hash, however sources or ids are distributed, and first pieces are packed group by group;
    full pieces are sequences of their own. All pieces are placed; one that exceeds a capacity by itself raises
    ValueError. A sequence number is the group's number and the sequence's number in it.
    """
    groups, most = max(1, -(-docs.count() // capacity.group)), capacity.tokens

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("doc_id", "ascending")])
        heads = table["head"].to_numpy()
        pieces = pa.compute.list_value_length(table["crcs"]).to_numpy().astype(np.int64)
        bins, offsets = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        short = np.flatnonzero(heads < most)
        bins[short], offsets[short] = best_fit(heads[short], capacity)
        full = np.where(heads < most, pieces - 1, pieces)
        if full.any():
            best_fit(np.array([most]), capacity)
        own = int(table["_group"][0].as_py()) << 36
        first = (bins[short].max() + 1 if len(short) else 0) + np.cumsum(full) - full
        bins = np.where(heads < most, bins, first)
        after = np.where(heads < most, first, first + 1)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(own + bins)).append_column("offset", pa.array(offsets)).append_column("next", pa.array(own + after))

    dealt = cut_documents(docs, tokenizer, most, end_id).withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = dealt.groupBy("_group").applyInArrow(place, _DOCUMENT + ", sequence_id bigint, offset bigint, next bigint")
    pieces = placed.select("doc_id", "row", "head", "sequence_id", "offset", "next", F.posexplode("crcs").alias("piece", "ids_crc32"))
    later = F.col("piece") > 0
    return pieces.select(
        "doc_id",
        "row",
        "piece",
        F.when(later, F.col("head") + (F.col("piece") - 1) * F.lit(most)).otherwise(0).cast("long").alias("start"),
        F.when(later, F.lit(most)).otherwise(F.col("head")).cast("long").alias("length"),
        "ids_crc32",
        F.when(later, F.col("next") + F.col("piece") - 1).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(later, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )

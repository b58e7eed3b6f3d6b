"""Packing token pieces into windows by minimum bin slack.

Each window takes the longest piece that is left and, of all multisets of the lengths that are left, one whose sum comes
closest to the room: subset sums are the bits of an integer, a length that is there c times is shifted in by 1, 2, 4, ...
copies, and the copies taken are read back from the bits before each shift.
"""

from __future__ import annotations

import bisect
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
from foliant.llm.word_ids import encoder


@dataclass(frozen=True)
class Windows:
    tokens: int = 2048
    #: Documents whose remainders one task packs on average.
    group: int = 32768
    #: One in so many documents, by a hash, brings its last ids along so that it can be cut to fill windows.
    filler: int = 32


_DOCUMENT = "doc_id bigint, row bigint, n bigint, crcs array<bigint>, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())])
_PIECE = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_PIECE_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def cut_documents(docs: DataFrame, tokenizer: str, how: Windows = Windows(), end_id: int = 1) -> DataFrame:
    """(doc_id, row, n, crcs, ids): the ids of every whole text and ``end_id``, one row for each row of ``docs``.

    The first piece of a document has ``n`` modulo a window's tokens, unless that is 0, and all others are full; crcs
    has the crc32 of each. ``ids`` holds the first piece of fillers and is null for others. A null or empty text is the end
    id alone; rows with a null or repeated doc_id are documents of their own, told apart by ``row`` (a hash of the id, the
    ids of the text, the task, and how many equal rows the task had before, which no order of rows changes).
    """
    most = how.tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text"):
            rows, sizes, crcs, kept = [], [], [], []
            docs = batch.column("doc_id").to_pylist()
            for doc, data in zip(docs, machine.encode(batch.column("text").to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                own = xxhash.xxh3_64_intdigest(data, 0 if doc is None else (2 * doc + 1) & ((1 << 64) - 1))
                seen[own] = before = seen.get(own, -1) + 1
                row = xxhash.xxh3_64_intdigest(struct.pack("<Qqq", own, task, before))
                rows.append(row - (1 << 63))
                sizes.append(n)
                cuts = [0, *range(n % most or most, n, most), n]
                view = memoryview(data)
                crcs.append([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                kept.append(bytes(view[: 4 * cuts[1]]) if n % most and row % how.filler == 0 else None)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((docs, rows, sizes, crcs, kept), _ARROW, strict=True)], schema=_ARROW)
        trim()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _DOCUMENT)


class Multiset:
    """Lengths with how often each is left."""

    def __init__(self, lengths: np.ndarray) -> None:
        values, counts = np.unique(lengths, return_counts=True)
        self.lengths: list[int] = values.tolist()
        self.left: dict[int, int] = dict(zip(self.lengths, counts.tolist(), strict=True))

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def fill(self, room: int) -> list[tuple[int, int]]:
        """[(length, how many)] of a submultiset whose sum is as near to ``room`` as any comes from below; longer ones first.

        The bits of ``sums`` are the sums that can be had. The search ends as soon as ``room`` itself is one of them.
        """
        sums, whole, steps = 1, (1 << (room + 1)) - 1, []
        for k in range(bisect.bisect_right(self.lengths, room) - 1, -1, -1):
            length = self.lengths[k]
            copies, some = min(self.left[length], room // length), 1
            while copies:
                some = min(some, copies)
                steps.append((length, some, sums))
                sums |= (sums << (length * some)) & whole
                copies -= some
                some *= 2
            if sums >> room & 1:
                break
        at, taken = sums.bit_length() - 1, {}
        for length, some, before in reversed(steps):
            if not before >> at & 1:
                taken[length] = taken.get(length, 0) + some
                at -= length * some
        return sorted(taken.items(), reverse=True)


def slack_windows(lengths: np.ndarray, tokens: int) -> list[list[tuple[int, int]]]:
    """[(length, how many)] of each window; every length is placed, each window with the longest one left."""
    left, out = Multiset(lengths), []
    while left.lengths:
        longest = left.lengths[-1]
        left.take(longest)
        window = {longest: 1}
        for length, n in left.fill(tokens - longest) if longest < tokens else ():
            left.take(length, n)
            window[length] = window.get(length, 0) + n
        out.append(sorted(window.items(), reverse=True))
    return out


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum up to ``n``, the greatest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def place(n: np.ndarray, fillers: np.ndarray, tokens: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of the first pieces of ``n`` ids, of which ``fillers`` may be cut.

    The pieces of other documents stay whole and are packed by slack. What a window lacks is cut from the fillers, one
    after the other; what is left of them fills windows of ``tokens`` ids and at last windows of powers of two, which need
    no padding. Windows stay short, and are padded, only where there are no fillers or they are used up.
    """
    whole = np.flatnonzero(~fillers & (n > 0))
    order = whole[np.argsort(n[whole], kind="stable")]
    queues: dict[int, Iterator[int]] = {}
    values, first = np.unique(n[order], return_index=True)
    for value, own in zip(values.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        queues[value] = iter(own.tolist())
    out: list[tuple[int, int, int, int, int]] = []
    open_windows: list[tuple[int, int]] = []
    number = 0
    for window in slack_windows(n[whole], tokens):
        used = 0
        for length, copies in window:
            for _ in range(copies):
                out.append((next(queues[length]), 0, length, number, used))
                used += length
        if used & (used - 1):
            open_windows.append((number, used))
        number += 1
    supply = [[i, 0] for i in np.flatnonzero(fillers & (n > 0)).tolist()]
    supply.reverse()
    rest = int(n[[i for i, _ in supply]].sum()) if supply else 0

    def cut(window: int, used: int, room: int) -> None:
        while room:
            i, start = supply[-1]
            length = min(room, int(n[i]) - start)
            out.append((i, start, length, window, used))
            used, room = used + length, room - length
            supply[-1][1] += length
            if supply[-1][1] == n[i]:
                supply.pop()

    for window, used in sorted(open_windows, key=lambda x: (-x[1], x[0])):
        # Up to the whole window, or else up to the power of two that is reached with what is left.
        room = next((size - used for size in sorted({tokens, *(1 << k for k in range(tokens.bit_length()) if used < 1 << k <= tokens)}, reverse=True) if size - used <= rest), 0)
        cut(window, used, room)
        rest -= room
    while rest:
        size = tokens if rest >= tokens else powers_of_two(rest)[0]
        cut(number, 0, size)
        number, rest = number + 1, rest - size
    return out


def pack_documents(docs: DataFrame, tokenizer: str, how: Windows = Windows(), end_id: int = 1) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces.

    What is cut: every document longer than a window, into full pieces and a first one that is shorter; and fillers. Texts are
    encoded once, and what is exchanged has neither texts nor ids but the fillers' (``cut_documents``); these rows are dealt into
    groups of about ``how.group`` by a hash, however sources or ids are distributed, and each group is packed in one task.
    Full pieces are sequences of their own. An empty table gives no rows. A sequence number is the group's number and the
    sequence's number in it.
    """
    groups, most = max(1, -(-docs.count() // how.group)), how.tokens
    cuts = cut_documents(docs, tokenizer, how, end_id)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("doc_id", "ascending")])
        n, own = table["n"].to_numpy(), int(table["_group"][0].as_py()) << 36
        head = n % most
        crcs = table["crcs"].combine_chunks()
        ends = np.asarray(crcs.offsets).astype(np.int64)
        values = np.asarray(crcs.values)
        placed = np.array(place(head, table["ids"].is_valid().to_numpy(), most), np.int64).reshape(-1, 5)
        doc, start, length, window, offset = placed.T
        own_crc = values[ends[doc]] if len(doc) else np.zeros(0, np.int64)
        for k in np.flatnonzero((length < head[doc])).tolist():
            data = memoryview(table["ids"][int(doc[k])].as_py())
            own_crc[k] = zlib.crc32(data[4 * int(start[k]) : 4 * int(start[k] + length[k])])
        full = n // most
        of = np.repeat(np.arange(len(n)), full)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
        after = int(window.max()) + 1 if len(window) else 0
        doc, start, length = np.concatenate([doc, of]), np.concatenate([start, head[of] + rank * most]), np.concatenate([length, np.full(len(of), most)])
        crc = np.concatenate([own_crc, values[ends[of] + (head[of] > 0) + rank]])
        window, offset = np.concatenate([window, after + np.arange(len(of))]), np.concatenate([offset, np.zeros(len(of), np.int64)])
        at = pa.array(doc)
        return pa.table([table["doc_id"].take(at), table["row"].take(at), *map(pa.array, (start, length, crc, n[doc], own + window, offset))], schema=_PIECE_ARROW)

    return cuts.withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("_group").applyInArrow(pack, _PIECE)

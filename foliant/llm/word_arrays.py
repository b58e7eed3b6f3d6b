"""Words of texts as Arrow arrays, found by classes of bytes and without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from foliant.llm.common import STEP_BYTES, small_batches

#: What a byte is: part of a word, between words, or between pieces (and words).
WORD, BLANK, BREAK = range(3)


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte. Only ASCII characters may part words, so that no character of a word is torn."""
    table = np.full(256, WORD, np.uint8)
    for characters, kind in ((blanks, BLANK), (breaks, BREAK)):
        if any(c > 0x7F for c in characters):
            raise ValueError("words can be parted at ASCII characters only")
        table[list(characters)] = kind
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@dataclass
class Words:
    """Words in their order; ``row`` is the place of their text in the batch, ``piece`` grows where a piece or a text ends.

    A text longer than a step comes in several of these; those after the first are ``continued``, and ``piece`` starts
    at 0 for the piece that may go on from the one before. ``pieces`` is how many breaks and texts there were.
    """

    words: pa.Array
    row: np.ndarray
    piece: np.ndarray
    pieces: int
    continued: bool


def _cut(data: np.ndarray, begin: int, end: int, classes: np.ndarray, step: int) -> int:
    """Where the part of a long text that starts at ``begin`` ends: after a byte between words, if there is one."""
    at = min(begin + step, end)
    if at == end:
        return end
    back = np.flatnonzero(classes[data[begin:at]] != WORD)
    if len(back):
        return begin + int(back[-1]) + 1
    while at < end:
        ahead = np.flatnonzero(classes[data[at : at + step]] != WORD)
        if len(ahead):
            return min(at + int(ahead[0]) + 1, end)
        at += step
    return end


def words_of(column: pa.Array, classes: np.ndarray, lower: np.ndarray | None = None, step: int = STEP_BYTES) -> Iterator[Words]:
    """The words of a string column without nulls. Texts are short enough together for one step, or there is but one."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 1 and offsets[1] - offsets[0] > 2 * step:
        begin, end = int(offsets[0]), int(offsets[1])
        at = begin
        while at < end:
            stop = _cut(data, at, end, classes, step)
            yield _words(data[at:stop], np.zeros(1, np.int64), classes, lower, at > begin)
            at = stop
    elif len(column):
        first = int(offsets[0])
        yield _words(data[first : int(offsets[-1])], offsets[:-1] - first, classes, lower, False)


def _words(data: np.ndarray, rows: np.ndarray, classes: np.ndarray, lower: np.ndarray | None, continued: bool) -> Words:
    kind = classes[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = rows[rows < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    held = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    letters = data[inside]
    if lower is not None:
        letters = lower[letters]
    ends = np.append(held[at] - 1, len(letters))
    kinds = (pa.large_binary(), np.int64) if len(letters) >= 1 << 31 else (pa.binary(), np.int32)
    words = pa.Array.from_buffers(kinds[0], len(at), [None, pa.py_buffer(ends.astype(kinds[1])), pa.py_buffer(letters)])
    breaks = np.cumsum(kind == BREAK, dtype=np.int64)
    row = np.searchsorted(rows, at, "right") - 1
    return Words(words, row, breaks[at] + row, int(breaks[-1] if len(breaks) else 0) + len(rows), continued)


def batches_of_words(batches: Iterator[pa.RecordBatch], column: str, classes: np.ndarray, lower: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """(batch, words) for small slices of the batches in order; a batch comes again for each part of a long text."""
    for batch in small_batches(batches, column):
        for words in words_of(batch.column(column), classes, lower):
            yield batch, words

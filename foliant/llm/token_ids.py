"""Token ids of whole texts by the tokenizers library, which encodes each pre-token once.

Byte-level BPE never merges across pre-tokens, so that the ids of a text are those of its pre-tokens in order.
Texts are cut into pre-tokens by array operations over their code points; each pre-token is found by a hash and compared,
code point by code point, with the one that is known under it. The library is asked for those that are new to the worker,
and for whole parts of texts in which two different pre-tokens have the same hash.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import regex

_U = np.uint64
#: Pre-tokens, and ids and code points of them, kept by one Python worker before it starts afresh.
MEMO, MEMO_IDS, MEMO_POINTS = 1_000_000, 10_000_000, 16_000_000
#: Pre-tokens are looked up first in a table of so many places, where a later one displaces an earlier one.
SLOTS = 21
#: Code points handled at once, and of a text that are at most handled as one part.
STEP = 700_000
#: Classes of code points. What stands between texts is of the last one.
OTHER, LETTER, NUMBER, SPACE, BETWEEN = range(5)
_BETWEEN_POINT = 0x10FFFF + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(_BETWEEN_POINT + 1, np.uint8)
    points = [p for p in range(_BETWEEN_POINT) if not 0xD800 <= p < 0xE000]
    every = "".join(map(chr, points))
    at = np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = kind
    table[_BETWEEN_POINT] = BETWEEN
    return table


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    factor = 0x9E3779B97F4A7C15
    n = 2 * STEP + 2
    with np.errstate(over="ignore"):
        up = np.concatenate([[_U(1)], np.full(n - 1, _U(factor))]).cumprod(dtype=_U)
        down = np.concatenate([[_U(1)], np.full(n - 1, _U(pow(factor, -1, 1 << 64)))]).cumprod(dtype=_U)
    return up, down


@functools.lru_cache(maxsize=1)
def _count() -> np.ndarray:
    return np.arange(2 * STEP + 2)


def pre_tokens(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in code points of texts that each end with one of class BETWEEN.

    The rules of byte-level BPE files that say use_regex: runs of letters, of numbers, and of anything else that is not
    white space, each with one space before it; of a run of white space before other text, all but the last
    character, and that one if it is not taken by what follows; and before any of these, at an apostrophe, s t m d re ve ll.
    """
    kind = _classes()[points]
    change = np.ones(len(points), bool)
    change[1:] = kind[1:] != kind[:-1]
    space = kind == SPACE
    starts = change | (kind == BETWEEN)
    # The last of some white space before other text begins a pre-token, and a blank takes the text after it along.
    last = np.zeros(len(points), bool)
    last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != BETWEEN)
    starts |= last
    taken = np.zeros(len(points), bool)
    taken[1:] = last[:-1] & (points[:-1] == 0x20)
    starts &= ~taken
    quotes = np.flatnonzero((points == 0x27) & starts & (kind == OTHER))
    for p in quotes.tolist():
        if p + 2 < len(points) and kind[p + 1] == LETTER:
            a, b = int(points[p + 1]), int(points[p + 2])
            n = 2 if a in (0x73, 0x74, 0x6D, 0x64) else 3 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
            if n:
                starts[p + 1] = False
                starts[p + n] = True
    return np.flatnonzero(starts)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as its size, one range after the other."""
    done = np.cumsum(sizes)
    return np.repeat(begins - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens; their strings are ordinary text.

    Files of another build than byte-level BPE (a normalizer, another pre-tokenizer) are encoded text by text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            build = json.load(f)
        pre = build.get("pre_tokenizer") or {}
        self.by_piece = build.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        line = self._encode(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self._forget()

    def _forget(self) -> None:
        # Hashes of the known pre-tokens in order, and beside them where their ids are.
        self.keys, self.rows = np.zeros(0, _U), np.zeros(0, np.int64)
        self.slot_keys, self.slot_rows = np.zeros(1 << SLOTS, _U), np.zeros(1 << SLOTS, np.int32)
        self.ids, self.offsets = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.points, self.begins = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens: those that do not end in white space as lines of one text, the others one by one."""
        out: list = [None if p else np.zeros(0, np.uint32) for p in pieces]
        lines = [i for i, p in enumerate(pieces) if p and self.line is not None and not p[-1].isspace()]
        for at in range(0, len(lines), 20_000):
            some = lines[at : at + 20_000]
            ids = self._encode(["\n".join(pieces[i] for i in some)])[0]
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(some) - 1:
                begin = 0
                for i, end in zip(some, [*ends.tolist(), len(ids)], strict=True):
                    out[i] = ids[begin:end]
                    begin = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._encode([pieces[i] for i in rest]), strict=True) if rest else ():
            out[i] = ids
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str], points: np.ndarray, sizes: np.ndarray) -> None:
        """Adds pre-tokens with their hashes, in order of the hashes, and with their code points one after the other."""
        found = self._encode_pieces(pieces)
        self.ids, self.offsets = self._appended(self.ids, self.offsets, np.concatenate(found) if found else self.ids[:0], np.array([len(x) for x in found], np.int64))
        self.points, self.begins = self._appended(self.points, self.begins, points, sizes)
        at = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, np.arange(self.n, self.n + len(found)))
        self.keys = np.insert(self.keys, at, keys)
        self.n += len(found)

    def _appended(self, flat: np.ndarray, ends: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = int(ends[self.n])
        while used + len(more) > len(flat):
            flat = np.concatenate([flat, np.zeros_like(flat)])
        while self.n + len(sizes) + 1 > len(ends):
            ends = np.concatenate([ends, np.zeros_like(ends)])
        flat[used : used + len(more)] = more
        ends[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        return flat, ends

    def _parts(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of the text, part of it); a long text is cut only where a letter is followed by a space and a letter."""
        out = []
        for k, text in enumerate(texts):
            begin = 0
            while len(text) - begin > STEP:
                at = text.find(" ", begin + STEP)
                while at > 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
                    at = text.find(" ", at + 1)
                if at < 0:
                    break
                out.append((k, text[begin:at]))
                begin = at
            out.append((k, text[begin:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [x.tobytes() for x in self._encode(texts)]
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for k, part in self._parts(texts):
            if len(part) > STEP * 2 - 2:  # no place to cut it
                if held:
                    self._add(held, out)
                    held, size = [], 0
                out[k].append(self._encode([part])[0].tobytes())
                continue
            if held and size + len(part) + 1 > STEP:
                self._add(held, out)
                held, size = [], 0
            held.append((k, part))
            size += len(part) + 1
        if held:
            self._add(held, out)
        return [b"".join(x) for x in out]

    def _add(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        joined = "\0".join(p for _, p in parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        ends = np.cumsum([len(p) + 1 for _, p in parts])
        points[ends - 1] = _BETWEEN_POINT
        begin = pre_tokens(points)
        end = np.append(begin[1:], len(points))
        up, down = _powers()
        sums = np.zeros(len(points) + 1, _U)
        np.cumsum((points + _U(1)) * up[: len(points)], out=sums[1:])
        sizes = end - begin
        keys = (sums[end] - sums[begin]) * down[begin] + sizes.astype(_U) * _U(0xD1B54A32D192ED03)
        if self.n > MEMO or self.offsets[self.n] > MEMO_IDS or self.begins[self.n] > MEMO_POINTS:
            self._forget()
        slot = keys >> _U(64 - SLOTS)
        row = self.slot_rows.take(slot).astype(np.int64)
        missed = np.flatnonzero(self.slot_keys.take(slot) != keys)
        if len(missed):
            values, first, which = np.unique(keys[missed], return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, values)
            known = np.zeros(len(values), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == values[inside]
            new = missed[first[~known]]
            spans = zip(begin[new].tolist(), end[new].tolist(), strict=True)
            pieces = ["" if points[a] == _BETWEEN_POINT else joined[a:b] for a, b in spans]
            self._learn(values[~known], pieces, points[_ranges(begin[new], sizes[new])], sizes[new])
            found = self.rows[np.searchsorted(self.keys, values)]
            row[missed] = found[which]
            slot = values >> _U(64 - SLOTS)
            self.slot_keys[slot], self.slot_rows[slot] = values, found
        same = np.array_equal(self.begins[row + 1] - self.begins[row], sizes)
        if same:
            places = np.repeat(self.begins[row] - begin, sizes)
            places += _count()[: len(points)]
            same = np.array_equal(self.points.take(places), points)
        if not same:
            for (k, _), ids in zip(parts, self._encode([p for _, p in parts]), strict=True):
                out[k].append(ids.tobytes())
            return
        lengths = (self.offsets[row + 1] - self.offsets[row]).astype(np.int64)
        done = np.cumsum(lengths)
        ids = self.ids[_ranges(self.offsets[row], lengths)].tobytes()
        # A text ends with the pre-token that stands between texts, which has no ids.
        at = np.searchsorted(begin, ends - 1)
        stops = done[at].tolist()
        start = 0
        for (k, _), stop in zip(parts, stops, strict=True):
            out[k].append(ids[4 * start : 4 * stop])
            start = stop


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

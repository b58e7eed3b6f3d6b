"""Token ids of whole texts by tokenizer files that drop white space: each word is encoded once by the library.

In such a file no token reaches over white space and what stands on one side of it does not change the other: the
normalizers are NFC, the replacement of white space and lower case, and pre-tokens are matches of a pattern that
leaves white space out. The ids of a text are thus those of its words, parted at blanks, tabs and line ends, in order.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from foliant.llm import token_ids, word_arrays

#: Words, and ids and bytes of them, kept by one Python worker before it starts afresh. Longer words are not kept.
MEMO, MEMO_IDS, MEMO_BYTES, LONGEST = 1_500_000, 8_000_000, 30_000_000, 200
_BLANKS = word_arrays.byte_classes(b" \t\n\r")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_white_space(build: dict) -> bool:
    """Whether a tokenizer file is known to be of the build above."""
    normal = (build.get("normalizer") or {}).get("normalizers") or []
    split = (build.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [n.get("type") for n in normal] != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in split] != ["Split", "ByteLevel"]:
        return False
    replace, (cut, level) = normal[1], split
    whole = replace.get("pattern") == {"Regex": r"\s+"} and replace.get("content") == " " and cut.get("behavior") == "Removed" and cut.get("invert") is True
    pattern = (cut.get("pattern") or {}).get("Regex", "")
    # Every alternative of the pattern starts and ends inside a word: no blank, no look-around, no class that holds white space.
    inside = "(?" not in pattern and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "") and "[^" not in pattern.replace(r"[^\s", "")
    stripped = any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t.get("content", "")) for t in build.get("added_tokens") or [])
    return whole and inside and not stripped and not level.get("add_prefix_space", True) and not level.get("use_regex", True)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens; their strings are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_bytes = 0

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each word has), of words without blanks: as one text, with a bar between any two."""
        joined = b" | ".join(words)
        if self.bar is not None and joined.count(b"|") == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
            bars = ids == self.bar
            at = np.flatnonzero(bars)
            if len(at) == len(words) - 1:
                ends = np.append(at, len(ids))
                return ids[~bars], np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Words with a bar are few; the others are encoded some thousands at a time."""
        odd = [w for w in words if b"|" in w]
        if odd:
            words = [w for w in words if b"|" not in w] + odd
        parts = [self._library(part) for cut in (words[: len(words) - len(odd)], odd) for at in range(0, len(cut), 20_000) if (part := cut[at : at + 20_000])]
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        at = len(self.known)
        while at + len(words) > len(self.begins):
            self.begins, self.sizes = np.concatenate([self.begins, self.begins]), np.concatenate([self.sizes, self.sizes])
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.begins[at : at + len(words)] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(words)] = sizes
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.n_ids += len(flat)
        self.n_bytes += sum(map(len, words))

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each word has)."""
        coded = words.dictionary_encode()
        # Words have no blanks: joined and split again they become Python's in one go.
        distinct = pa.compute.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), b" ")[0].as_py().split(b" ") if len(words) else []
        if len(self.known) > MEMO or self.n_ids > MEMO_IDS or self.n_bytes > MEMO_BYTES:
            self._forget()
        rows = list(map(self.known.get, distinct))
        if None in rows:
            self._learn([w for w, row in zip(distinct, rows, strict=True) if row is None and len(w) <= LONGEST])
            rows = [-1 if row is None else row for row in map(self.known.get, distinct)]
        at = np.array(rows, np.int64)
        begins, sizes, ids = self.begins[at], self.sizes[at], self.ids
        long = np.flatnonzero(at < 0)
        if len(long):
            found, sizes[long] = self._library([distinct[i] for i in long.tolist()])
            begins[long] = self.n_ids + np.cumsum(sizes[long]) - sizes[long]
            ids = np.concatenate([ids[: self.n_ids], found])
        which = np.asarray(coded.indices)
        n = sizes[which]
        done = np.cumsum(n)
        places = np.repeat(begins[which] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)
        return ids[places], n

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        begin, held = 0, 0
        for i, text in enumerate([*texts, None]):
            n = 0 if text is None else len(text)
            if text is None or (held and held + n > word_arrays.STEP_BYTES):
                for words in word_arrays.words_of(pa.array(texts[begin:i], pa.large_string()), _BLANKS):
                    ids, sizes = self._ids(words.words)
                    totals = np.bincount(words.row, weights=sizes, minlength=i - begin).astype(np.int64)
                    stops = np.cumsum(totals).tolist()
                    for k, (size, stop) in enumerate(zip(totals.tolist(), stops, strict=True)):
                        if size:
                            out[begin + k].append(ids[stop - size : stop].astype("<u4", copy=False).tobytes())
                begin, held = i, 0
            held += n
        return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | token_ids.Encoder:
    """The fastest encoder that is known to give the library's ids for this file."""
    with open(path, encoding="utf-8") as f:
        build = json.load(f)
    return WordEncoder(path) if drops_white_space(build) else token_ids.encoder(path)

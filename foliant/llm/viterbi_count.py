"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates, for every end position of a word, the pieces that end
there, longest first. The dynamic programme carries for each position the best score, the number of
tokens on that path, and whether the last is unknown; no back pointers are kept and no path is walked.

Ties and unknown characters follow the unigram model of the tokenizers library: candidates for a position
come in the order of their beginnings and only a strictly better score replaces one; a character that is no
piece by itself may be unknown at the lowest score less 10. An unknown character is as many tokens as it has UTF-8 bytes
where the vocabulary has a piece for each byte; without these, neighbouring unknowns are one token.

The vocabulary file has merge ranks and no probabilities. Tokenizers are not trained here, so that the probabilities follow the
ranks by a rule: the Zipf-Mandelbrot law.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliant.llm.common import pick, trim

SPACE = "▁"
#: What the tokenizers library takes off the lowest score for an unknown character (a fixed value).
UNKNOWN_PENALTY = 10.0
#: Words remembered by one Python worker before it starts afresh, and their longest length.
MEMO, LONGEST = 400_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: The shift of ranks in the Zipf-Mandelbrot law.
SHIFT = 2.7


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores. ``unknown`` is the place of a piece for unknown text among them, -1 if there is none.

    ``byte_pieces``: unknown characters become one token for each byte. ``whole``: spaces are written as ``SPACE`` and one
    is put before the text, which is then one sequence, as the vocabulary files have it; otherwise a text is cut before
    each space first, and a space is put before it only if it begins with none.
    """

    pieces: tuple[tuple[str, float], ...]
    unknown: int = -1
    byte_pieces: bool = False
    whole: bool = False


def read_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece file: no control, unknown, unused or byte piece can be matched in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + SHIFT) for r in range(1, len(ranked) + 1)))
    pieces = tuple((model.id_to_piece(i), -math.log(r + SHIFT) - total) for r, i in enumerate(ranked, 1))
    return Vocabulary(pieces, byte_pieces=sum(map(model.is_byte, ids)) == 256, whole=True)


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.found = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary.pieces):
            if piece:
                self.found.add_word(piece, (len(piece), float(score), i == vocabulary.unknown))
        self.found.make_automaton()
        self.unknown = min(score for _, score in vocabulary.pieces) - UNKNOWN_PENALTY
        # Pieces that end before every space that follows something else let a text be counted word by word.
        inner = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in vocabulary.pieces)
        fused = not vocabulary.byte_pieces and not any(piece == SPACE for piece, _ in vocabulary.pieces)
        self.units = re.compile(f"{SPACE}.*" if inner or fused else f"{SPACE}+[^{SPACE}]*", re.S)
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of a word."""
        n = len(word)
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        pieces, by_bytes = self.found.iter(word), self.vocabulary.byte_pieces
        at, hit = next(pieces, (n, None))
        for end in range(1, n + 1):
            best, single = None, False
            while at == end - 1:
                length, value, unknown = hit
                single = single or length == 1
                begin = end - length
                total = value + score[begin]
                if best is None or total > best:
                    best, score[end], odd[end] = total, total, unknown
                    count[end] = count[begin] + (not (unknown and odd[begin]))
                at, hit = next(pieces, (n, None))
            if not single:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    more = len(word[end - 1].encode("utf-8", "surrogatepass")) if by_bytes else not odd[end - 1]
                    score[end], odd[end], count[end] = total, True, count[end - 1] + more
        return count[n], score[n]

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text: a space begins a word and is part of it, also before the first."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        if self.vocabulary.whole:
            words = self.units.findall(SPACE + marked)
        else:
            words = [SPACE + w for w in (marked if marked.startswith(SPACE) else SPACE + marked).split(SPACE)[1:]]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, tokens, score = self.memo, 0, 0.0
        for word in words:
            known = memo.get(word)
            if known is None:
                known = self.word(word)
                if len(word) <= LONGEST:
                    memo[word] = known
            tokens += known[0]
            score += known[1]
        return tokens, score


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def token_count(text: Column, vocabulary: str) -> Column:
    """struct(n_tokens, score) of a whole text; (0, 0) for a null or empty one."""

    @arrow_udf("n_tokens bigint, score double")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = counter(vocabulary)
        for texts in batches:
            both = [machine.text(x.as_py() or "") for x in texts]
            yield pa.StructArray.from_arrays([pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.float64())], names=["n_tokens", "score"])
        trim()

    return count(text.cast("string"))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, score) for every row of ``docs``; null ids and repeated rows stay, an empty table gives no rows."""
    rows = pick(docs, "doc_id", "text").select("doc_id", token_count(F.col("text"), vocabulary).alias("_c"))
    return rows.select("doc_id", "_c.n_tokens", "_c.score")

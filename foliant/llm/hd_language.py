"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's vector binds (multiplies)
the vectors of its letters, each permuted by its place; a text's profile bundles (adds) the vectors of all its
n-grams. A language's prototype bundles the profiles of its training texts, each divided by its number of n-grams. A text
is compared with the prototypes by the cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from foliant.llm.common import discard, pick, stored, trim

#: Code points of text, and texts, that are counted in one matrix, and the counts that it holds at most.
STEP_POINTS, STEP_TEXTS, STEP_COUNTS = 400_000, 128, 6_000_000
#: N-grams whose vectors are made at once.
BLOCK = 4096
UNKNOWN = "und"


@dataclass(frozen=True)
class Space:
    dimensions: int = 1024
    n: int = 3
    seed: int = 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def symbols(text: str, n: int) -> tuple[list[np.ndarray], int, int]:
    """(a text's symbols in pieces, its number of n-grams, its number of letters).

    Text is lower-cased; a run of anything but letters is one boundary, and every text begins and ends with one. Symbols
    are code points, a boundary is 0. A piece begins with the n - 1 symbols before it, so that the pieces' n-grams
    are those of the text, wherever it is cut.
    """
    low, pieces, held, letters, after_letter, total = text.lower(), [], np.zeros(1, np.uint32), 0, False, 1
    for at in range(0, len(low), STEP_POINTS):
        points = np.frombuffer(low[at : at + STEP_POINTS].encode("utf-32-le", "surrogatepass"), "<u4")
        keep = _letters()[points]
        before = np.empty(len(keep), bool)
        before[0], before[1:] = after_letter, keep[:-1]
        chosen = keep | before
        new = np.where(keep, points, 0)[chosen].astype(np.uint32)
        after_letter = bool(keep[-1])
        if at + STEP_POINTS >= len(low) and after_letter:
            new = np.append(new, np.uint32(0))
        letters += int(keep.sum())
        total += len(new)
        held = np.concatenate([held, new])
        if len(held) >= n:
            pieces.append(held)
            held = held[len(held) - n + 1 :]
    return pieces, max(0, total - n + 1), letters


class Profiler:
    """Profiles of whole texts, as rows of a matrix: sums of the vectors of the n-grams of their symbols."""

    def __init__(self, space: Space) -> None:
        self.space = space
        # More dimensions: fewer n-grams at once, and fewer letters kept.
        self.block = max(1, BLOCK * 1024 // space.dimensions // (2 if space.dimensions > 1024 else 1))
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > self.block:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.space.seed, point])).integers(0, 2, self.space.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.float32)
        return self.letters[point]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors of n-grams given as rows of code points."""
        points, at = np.unique(grams, return_inverse=True)
        table = np.stack([self.letter(int(p)) for p in points])
        at = at.reshape(grams.shape)
        out = np.ones((len(grams), self.space.dimensions), np.float32)
        for place in range(self.space.n):
            out *= np.roll(table, self.space.n - 1 - place, axis=1)[at[:, place]]
        return out

    def profiles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(profile of each text, its number of letters)."""
        out = np.zeros((len(texts), self.space.dimensions), np.float32)
        letters = np.zeros(len(texts), np.int64)
        todo, held = [], 0
        for k, text in enumerate(texts):
            pieces, _, letters[k] = symbols(text, self.space.n)
            for piece in pieces:
                if todo and held + len(piece) > STEP_POINTS:
                    self._add(todo, out)
                    todo, held = [], 0
                todo.append((k, 1.0, piece))
                held += len(piece)
        self._add(todo, out)
        return out, letters

    def bundle(self, texts: list[str], owners: np.ndarray, n_owners: int) -> np.ndarray:
        """For each owner the sum of its texts' profiles, each divided by the text's number of n-grams."""
        out = np.zeros((n_owners, self.space.dimensions), np.float64)
        todo, held = [], 0
        for k, text in zip(owners.tolist(), texts, strict=True):
            pieces, n, _ = symbols(text, self.space.n)
            for piece in pieces:
                if todo and held + len(piece) > STEP_POINTS:
                    self._add(todo, out)
                    todo, held = [], 0
                todo.append((k, 1.0 / n, piece))
                held += len(piece)
        self._add(todo, out)
        return out

    def _add(self, pieces: list[tuple[int, float, np.ndarray]], out: np.ndarray) -> None:
        """Adds the weighted profiles of pieces (row of ``out``, weight, symbols) to their rows."""
        if not pieces:
            return
        rows, row = np.unique([k for k, *_ in pieces], return_inverse=True)
        weights = np.array([w for _, w, _ in pieces])
        n = self.space.n
        alphabet, code, who = self.coded([x for *_, x in pieces], n)
        base = len(alphabet)
        if not len(code):
            return
        codes, which = self._ranked(code, base**n) if base**n <= 4_000_000 else np.unique(code, return_inverse=True)
        if len(rows) * len(codes) > STEP_COUNTS and len(pieces) > 1:
            self._add(pieces[: len(pieces) // 2], out)
            self._add(pieces[len(pieces) // 2 :], out)
            return
        counts = np.bincount(row[who] * len(codes) + which, weights[who], len(rows) * len(codes)).reshape(len(rows), -1).astype(np.float32)
        total = np.zeros((len(rows), self.space.dimensions), np.float32)
        for b in range(0, len(codes), self.block):
            rest, grams = codes[b : b + self.block].copy(), np.empty((len(codes[b : b + self.block]), n), np.int64)
            for i in reversed(range(n)):
                grams[:, i] = alphabet[rest % base]
                rest //= base
            total += counts[:, b : b + self.block] @ self.vectors(grams)
        out[rows] += total

    @classmethod
    def coded(cls, pieces: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the distinct symbols of pieces, their n-grams as numbers to the base of how many there are, the piece of each n-gram)."""
        points, owner = np.concatenate(pieces), np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        alphabet, at = np.unique(points, return_inverse=True) if points.max() > 0x3FFFF else cls._ranked(points)
        count = max(0, len(points) - n + 1)
        code = np.zeros(count, np.int64)
        for i in range(n):
            code = code * len(alphabet) + at[i : count + i]
        inside = owner[n - 1 :] == owner[:count]
        return alphabet, code[inside], owner[:count][inside]

    @staticmethod
    def _ranked(x: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct values of small integers and each one's place among them, without a sort."""
        there = np.zeros(size or int(x.max()) + 1, bool)
        there[x] = True
        values = np.flatnonzero(there)
        place = np.empty(len(there), np.int32)
        place[values] = np.arange(len(values))
        return values, place[x].astype(np.int64)


def _texts(array: pa.Array, most: int | None = None) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for x in array:
        text = x.as_py() or ""
        if held and (len(held) >= (most or STEP_TEXTS) or size + len(text) > STEP_POINTS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def training_rows(docs: DataFrame, languages: int = 1000) -> DataFrame:
    """(lang, text) of all rows of ``docs`` that have both. More than ``languages`` languages raise ValueError."""
    rows = pick(docs, "text", "lang").where("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"more than {languages} languages")
    return rows.select("lang", "text")


def learn(docs: DataFrame, space: Space = Space(), languages: int = 1000) -> dict[str, np.ndarray]:
    """Language prototypes from all rows of ``docs`` (text, lang) that have a language and a letter. No rows give no prototypes."""
    grams = gram_weights(training_rows(docs, languages), space.n)
    out = prototypes(grams, space)
    discard(grams)
    return out


#: Weights of n-grams that a task sums up before it hands them on.
HELD_GRAMS = 300_000


def gram_weights(training: DataFrame, n: int = 3) -> DataFrame:
    """(lang, gram, weight) of all rows of ``training`` (lang, text), as a written table: the sums over a language's texts of each
    n-gram's share of the text. A gram is its symbols, four bytes each.

    Prototypes are sums over n-grams, of which there are few, so that a vector is made once for each n-gram and not for each text.
    """

    def added(texts: list[str], langs: list[str], held: dict[str, dict[bytes, float]]) -> None:
        found = [(lang, 1.0 / count, piece) for text, lang in zip(texts, langs, strict=True) for pieces, count, _ in [symbols(text, n)] for piece in pieces]
        if not found:
            return
        names, row = np.unique([lang for lang, *_ in found], return_inverse=True)
        weights = np.array([w for _, w, _ in found])
        alphabet, code, who = Profiler.coded([x for *_, x in found], n)
        size = len(alphabet) ** n
        for i, name in enumerate(names.tolist()):
            own = row[who] == i
            codes, which = Profiler._ranked(code[own], size) if size <= 4_000_000 else np.unique(code[own], return_inverse=True)
            sums = np.bincount(which, weights[who[own]], len(codes))
            points, rest = np.empty((len(codes), n), "<u4"), codes.copy()
            for at in reversed(range(n)):
                points[:, at] = alphabet[rest % len(alphabet)]
                rest //= len(alphabet)
            data, of = points.tobytes(), held.setdefault(name, {})
            for j, w in enumerate(sums.tolist()):
                gram = data[4 * n * j : 4 * n * (j + 1)]
                of[gram] = of.get(gram, 0.0) + w

    def given(held: dict[str, dict[bytes, float]]) -> Iterator[pa.RecordBatch]:
        for lang, of in held.items():
            yield pa.record_batch([pa.array([lang] * len(of), pa.string()), pa.array(list(of), pa.binary()), pa.array(np.round(list(of.values()), 9))], names=["lang", "gram", "weight"])
        held.clear()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, float]] = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in _texts(batch.column("text")):
                added(texts, langs[at : at + len(texts)], held)
                at += len(texts)
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield from given(held)
        yield from given(held)
        trim()

    parts = training.select("lang", "text").mapInArrow(sums, "lang string, gram binary, weight double")
    # Decimals add up to the same sum in any order.
    return stored(parts.groupBy("lang", "gram").agg(F.sum(F.col("weight").cast("decimal(30,9)")).cast("double").alias("weight")), "grams")


def prototypes(grams: DataFrame, space: Space = Space()) -> dict[str, np.ndarray]:
    """The prototype of each language of ``gram_weights``: the sum of the weighted vectors of its n-grams."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, total = Profiler(space), {}
        for batch in batches:
            names, row = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
            points = np.frombuffer(b"".join(batch.column("gram").to_pylist()), "<u4").reshape(-1, space.n).astype(np.int64)
            weights = np.zeros((len(names), len(row)))
            weights[row, np.arange(len(row))] = batch.column("weight").to_numpy()
            for b in range(0, len(row), profiler.block):
                made = weights[:, b : b + profiler.block] @ profiler.vectors(points[b : b + profiler.block]).astype(np.float64)
                for name, v in zip(names.tolist(), made, strict=True):
                    total[name] = total.get(name, 0) + v
        trim()
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([np.round(v, 9).tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = grams.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # Decimals add up to the same sum in any order.
    dims = parts.groupBy("lang", "i").agg(F.sum(F.col("x").cast("decimal(30,9)")).cast("double").alias("x"))
    made = dims.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(made, key=lambda r: r["lang"]) if any(x["x"] for x in r["v"])}


def _matrix(prototypes: dict[str, np.ndarray]) -> np.ndarray:
    return _unit(np.stack([prototypes[x] for x in sorted(prototypes)])).astype(np.float32)


#: Texts of a size (the power of two below their number of letters) are judged by their own kind only if so many were learned.
FEWEST = 50


def floors(training: DataFrame, prototypes: dict[str, np.ndarray], space: Space = Space()) -> list[float]:
    """The least cosine of a text whose number of letters is 2^i or more, for each i; 0 where too few texts were learned.

    All training texts tell, size by size, which cosine with the nearest prototype is usual: the floor is half
    the median, or the median less six times its distance from the lower quartile where that is lower. Sizes with fewer
    than ``FEWEST`` texts take the floor of the size below, whose cosines are lower. Quartiles are those of counts of cosines in
    steps of 2^-16, of which there is a bounded number.
    """
    matrix = _matrix(prototypes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(space)
        for batch in batches:
            for texts in _texts(batch.column("text")):
                profiles, letters = profiler.profiles(texts)
                best = (_unit(profiles) @ matrix.T).max(axis=1).astype(np.float64)
                yield pa.record_batch([pa.array(_sizes(letters), pa.int32()), pa.array(np.floor(best * 65536) / 65536)], names=["size", "cosine"])
        trim()

    judged = training.select("text").mapInArrow(judge, "size int, cosine double").where("size >= 0")
    counted = judged.groupBy("size", "cosine").agg(F.count(F.lit(1)).alias("c"))
    made = {r["size"]: r for r in counted.groupBy("size").agg(F.sum("c").alias("n"), F.percentile("cosine", F.array(F.lit(0.25), F.lit(0.5)), F.col("c")).alias("q")).collect()}
    out, last = [], 0.0
    for size in range(64):
        if size in made and made[size]["n"] >= FEWEST:
            low, median = made[size]["q"]
            last = max(0.0, min(median / 2, median - 6 * (median - low)))
        out.append(last)
    return out


def _sizes(letters: np.ndarray) -> np.ndarray:
    """The power of two below each number of letters; -1 for none."""
    return np.frexp(letters.astype(np.float64))[1].astype(np.int32) - 1


def language(text: Column, prototypes: dict[str, np.ndarray], space: Space = Space()) -> Column:
    """struct(lang, score): the nearest prototype and its cosine, 0 at least.

    A null text, one without a letter, or no prototypes at all: lang ``und`` and score 0. Equal cosines go to
    the language first in order. Texts are read whole.
    """
    names = sorted(prototypes)
    matrix = _matrix(prototypes) if names else np.zeros((0, space.dimensions), np.float32)

    @arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiler = Profiler(space)
        for array in batches:
            langs, scores = [], []
            for texts in _texts(array):
                profiles, letters = profiler.profiles(texts)
                lettered = (letters > 0) & bool(names)
                cosines = _unit(profiles) @ matrix.T if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                top = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
                langs += [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, top, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])
        trim()

    return predict(text.cast("string"))


def recognised(text: Column, coarse: dict[str, np.ndarray], fine: dict[str, np.ndarray], spaces: tuple[Space, Space], least: list[float], deviations: tuple[float, float] = (6.0, 4.0)) -> Column:
    """Whether a text has a letter and its cosine with the nearest prototype is that of a language.

    ``least`` are the ``floors`` in the coarse space. The cosine with a prototype that shares no n-gram with the text has a
    standard deviation of 1 / sqrt(dimensions): where ``deviations[0]`` of them exceed the floor, as they do for short
    texts, they are asked for instead, and a text below may still reach ``deviations[1]`` of them in the fine
    space, whose smaller deviation tells short texts of a language from others.
    """
    matrices = [_matrix(p) for p in (coarse, fine)]
    chance = [d / s.dimensions**0.5 for d, s in zip(deviations, spaces, strict=True)]
    usual = np.array([*least, 0.0])

    @arrow_udf("boolean")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profilers = [Profiler(s) for s in spaces]
        for array in batches:
            out: list[bool] = []
            for texts in _texts(array):
                profiles, letters = profilers[0].profiles(texts)
                floor = usual[_sizes(letters)]
                sure = (_unit(profiles) @ matrices[0].T).max(axis=1) >= np.maximum(chance[0], floor)
                doubtful = np.flatnonzero((letters > 0) & ~sure & (floor < chance[0]))
                for b in range(0, len(doubtful), STEP_TEXTS // 4):
                    some = doubtful[b : b + STEP_TEXTS // 4]
                    sure[some] = (_unit(profilers[1].profiles([texts[i] for i in some.tolist()])[0]) @ matrices[1].T).max(axis=1) >= chance[1]
                out += (sure & (letters > 0)).tolist()
            yield pa.array(out, pa.bool_())
        trim()

    return decide(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, space: Space = Space()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learned from all rows that are not held out.

    Only text and lang of rows with an id are learned from; a prediction sees the text alone.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    learned = learn(rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), space)
    said = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), learned, space).alias("_l"))
    return said.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))

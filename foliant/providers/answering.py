"""Answer, scoring, character-recognition and external-metric providers."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_blank, let
from foliant.operators import ranking
from foliant.operators.generation import context_block, extractive_answer, prompt
from foliant.operators.ranking import lexical_score, parsed_scores


logger = logging.getLogger("foliant.answering")


class AnswerProvider(Protocol):
    name: str

    def answer(self, question: Column, docs: Column) -> Column: ...


class Extractive:
    """The local default: a sentence of the first document."""

    name = "extractive"

    def answer(self, question: Column, docs: Column) -> Column:
        return extractive_answer(question, docs)


class Pace:
    """Lets calls begin no sooner than ``rate`` a second allow; 0 is no limit."""

    def __init__(self, rate: float) -> None:
        self._gap, self._next, self._lock = 1 / rate if rate > 0 else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self._gap:
            return
        with self._lock:
            now = time.monotonic()
            at = max(self._next, now)
            self._next = at + self._gap
        time.sleep(max(0.0, at - now))


class RemoteAnswer:
    """Answers of a client that takes (system prompt, message); one client for each task.

    A task has ``parallel`` calls open at once, for which the client has to be fit, begins no more than ``rate`` a second, and gives
    up a call after ``timeout`` seconds (0: never; the client's own timeout ends the call itself). A call that fails is repeated, with twice
    the wait each time; one that fails ``attempts`` times or gives an empty answer gives null, and the job goes on. Answers
    come in the order of the rows. Equal messages of one batch are asked once.
    """

    def __init__(
        self, client: Callable[[], Callable[[str, str], str]], system: str = "Answer from the context.", name: str = "remote", attempts: int = 3, wait: float = 1.0, parallel: int = 1, rate: float = 0.0, timeout: float = 0.0
    ) -> None:
        self.name, self._client, self._system = name, client, system
        self._attempts, self._wait, self._parallel, self._rate, self._timeout = attempts, wait, max(1, parallel), rate, timeout

    def generate(self, message: Column) -> Column:
        make, system, attempts, wait = self._client, self._system, self._attempts, self._wait
        parallel, rate, timeout = self._parallel, self._rate, self._timeout

        @F.pandas_udf("string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client, pace = make(), Pace(rate)

            def called(text: str) -> str | None:
                if not timeout:
                    return client(system, text)
                # A call that does not come back is left behind in a thread of its own, which does not keep the worker alive.
                box: list = []

                def run() -> None:
                    try:
                        box.append((client(system, text), None))
                    except Exception as e:
                        box.append((None, e))

                thread = threading.Thread(target=run, daemon=True)
                thread.start()
                thread.join(timeout)
                if not box:
                    raise TimeoutError(f"no answer in {timeout} seconds")
                if box[0][1] is not None:
                    raise box[0][1]
                return box[0][0]

            def one(text: str) -> str | None:
                for attempt in range(attempts):
                    if attempt:
                        time.sleep(wait * 2 ** (attempt - 1))
                    pace.wait()
                    try:
                        return (called(text) or "").strip() or None
                    except Exception as e:  # a call that keeps failing is a row without an answer
                        logger.info("answer failed: %s", e)
                return None

            with ThreadPoolExecutor(parallel) as pool:
                for texts in batches:
                    asked = [t for t in dict.fromkeys(texts) if t is not None]
                    found = dict(zip(asked, pool.map(one, asked), strict=True))
                    yield texts.map(lambda t: found.get(t))

        # Calls cost money: the optimizer must not make them twice or move them before a filter.
        return call.asNondeterministic()(message)

    def answer(self, question: Column, docs: Column) -> Column:
        return self.generate(prompt(context_block(docs), question))


class Scorer(Protocol):
    """What the engine asks of a reranker: the best ``top_k`` candidates of each question, with rerank_score and the new rank."""

    name: str

    def rerank(self, docs: DataFrame, top_k: int, min_score: float) -> DataFrame: ...


class LexicalScorer:
    """Each document by itself: the share of the question's key terms in it."""

    name = "lexical"

    def score(self, question: Column, content: Column) -> Column:
        return lexical_score(question, content)

    def rerank(self, docs: DataFrame, top_k: int, min_score: float) -> DataFrame:
        return ranking.reranked(docs, top_k, min_score, self.score(F.col("question"), F.col("content")))


class JudgeScorer:
    """Scores that a judge states in words for all documents of a question at once: one call for each question."""

    def __init__(self, provider: RemoteAnswer, name: str = "judge") -> None:
        self.name, self._provider = name, provider

    def scores(self, question: Column, contents: Column) -> Column:
        """A score for each content, neutral where the judge states none; null if the call failed. Blank questions and no contents are not asked."""
        cut = F.transform(contents, lambda c, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), F.substring(F.coalesce(c, F.lit("")), 1, ranking.SCORED_CHARS)))
        message = F.concat(F.lit("Question: "), question, F.lit("\n\nRate each document from 0 to 10 as JSON.\n\n"), F.array_join(cut, "\n\n"))
        response = self._provider.generate(F.when(~is_blank(question) & (F.size(contents) > 0), message))
        return let(response, lambda r: F.when(r.isNotNull(), parsed_scores(r, F.size(contents))))

    def rerank(self, docs: DataFrame, top_k: int, min_score: float) -> DataFrame:
        return ranking.reranked_together(docs, top_k, min_score, self.scores)


class NotConfigured(RuntimeError):
    pass


def _judge(provider: RemoteAnswer | None = None, **options) -> JudgeScorer:
    if provider is None:
        raise NotConfigured("the judge needs a provider that answers")
    return JudgeScorer(provider, **options)


_ANSWERS: dict[str, Callable[..., AnswerProvider]] = {"extractive": Extractive}
_SCORERS: dict[str, Callable[..., Scorer]] = {"lexical": LexicalScorer, "judge": _judge}


def register_answer(name: str, factory: Callable[..., AnswerProvider]) -> None:
    _ANSWERS[name] = factory


def register_scorer(name: str, factory: Callable[..., Scorer]) -> None:
    _SCORERS[name] = factory


def create_answer(name: str, **options) -> AnswerProvider:
    if name not in _ANSWERS:
        raise ValueError(f"unknown answer provider {name!r}; there are {sorted(_ANSWERS)}")
    return _ANSWERS[name](**options)


def create_scorer(name: str, **options) -> Scorer:
    if name not in _SCORERS:
        raise ValueError(f"unknown reranker {name!r}; there are {sorted(_SCORERS)}")
    return _SCORERS[name](**options)

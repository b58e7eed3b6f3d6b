import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names clash and one more."""

    def build(rows, extra=True):
        frame = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], DOCS)
        if extra:
            frame = frame.selectExpr("*", "doc_id as node", "text as key", "1 as label", "'x' as _text", "2 as size", "3 as rep")
        return frame

    return build


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))

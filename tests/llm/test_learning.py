"""What languages are learned from: all documents that are not held out."""

import numpy as np

from foliant.llm import hd_language


def test_prototypes_come_from_every_text(spark, make):
    space = hd_language.Space(dimensions=64)
    texts = [f"{'ab' if i % 2 else 'cd'} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4600)]
    rows = [(i, t, "x" if i % 46 else "y", "s") for i, t in enumerate(texts)]
    learned = hd_language.learn(make(rows), space)
    whole = hd_language.Profiler(space).bundle(texts, np.array([0 if i % 46 else 1 for i in range(len(texts))]), 2)
    assert sorted(learned) == ["x", "y"]
    assert np.allclose(learned["x"], whole[0], atol=0.05) and np.allclose(learned["y"], whole[1], atol=0.05)

"""How much of a search meets in one task."""

import random

from foliant.operators import knn


def test_tasks_are_bounded_however_the_vectors_are_stored(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    table = spark.createDataFrame(rows + [(200, None), (201, [0.0] * 6), (202, [1.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1)
    want = sorted(map(tuple, knn.top_k(table.withColumnRenamed("vec_id", "query_id"), table, 5, exclude_self=True).collect()))
    most, blocks = [], knn._blocks

    def spied(given, *how):
        most.append(max(given.rdd.glom().map(len).collect()))
        return blocks(given, *how)

    monkeypatch.setattr(knn, "_blocks", spied)
    monkeypatch.setattr(knn, "TASK_QUERIES", 60)
    monkeypatch.setattr(knn, "TASK_ROWS", 40, raising=False)
    monkeypatch.setattr(knn, "ROWS", 16)
    monkeypatch.setattr(knn, "QUERIES", 8)
    assert sorted(map(tuple, knn.top_k(table.withColumnRenamed("vec_id", "query_id"), table, 5, exclude_self=True).collect())) == want
    assert len(want) == 1000 and max(most) <= 60

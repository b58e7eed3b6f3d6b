"""Pruned search gives the rows of a comparison with everything, and looks at less."""

import numpy as np
import pytest

from foliant.operators import knn
from foliant.operators.pruned import PrunedIndex, fitted_centres

SCHEMA = "vec_id long, embedding array<double>, note string"


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def _asked(vectors):
    return vectors.withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equal_to_brute_force(spark, tmp_path, spread):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8))
    data = middles[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 8))
    data[:250] = data[0]  # a hot cell, and ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)]
    rows += [(900, None, None), (901, [0.0] * 8, "zero"), (902, [1.0], "short"), (903, [float("nan")] * 8, None), (904, [None] * 8, None), (905, [], None)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = PrunedIndex(spark, f"{tmp_path}/index", cells=16, sample=300)
    index.build(vectors, 8)
    assert index.rings().selectExpr("sum(n)").first()[0] == 700
    for own in (False, True):
        want = knn.top_k(_asked(vectors).where("query_id <> 902"), vectors.where("vec_id <> 902"), 4, exclude_self=own)
        assert _rows(index.search(_asked(vectors), 4, exclude_self=own)) == _rows(want)


def test_split_cells_and_more_hits_than_a_cell_holds(spark, tmp_path, monkeypatch):
    from foliant.operators import pruned

    monkeypatch.setattr(pruned, "TASK_ROWS", 20)
    monkeypatch.setattr(pruned, "HELD", 2)
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(rng.normal(size=(120, 4)))], SCHEMA)
    index = PrunedIndex(spark, f"{tmp_path}/index", cells=7)
    index.build(vectors, 4)
    assert _rows(index.search(_asked(vectors), 50)) == _rows(knn.top_k(_asked(vectors), vectors, 50))
    assert _rows(index.search(_asked(vectors), 500)) == _rows(knn.top_k(_asked(vectors), vectors, 500))


def test_groups_apart_are_skipped(spark, tmp_path):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 16))
    data = middles[np.arange(2000) % 40] + 0.02 * rng.normal(size=(2000, 16))
    vectors = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(data)], SCHEMA)
    index = PrunedIndex(spark, f"{tmp_path}/index", cells=64)
    index.build(vectors, 16)
    found = index.search(_asked(vectors).where("query_id % 10 = 0"), 5)
    assert _rows(found) == _rows(knn.top_k(_asked(vectors).where("query_id % 10 = 0"), vectors, 5))
    assert found.selectExpr("avg(compared)").first()[0] < 0.2 * 2000


def test_empty_tables_and_a_second_build(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b")], SCHEMA)
    index = PrunedIndex(spark, f"{tmp_path}/index")
    index.build(none, 2)
    assert index.search(_asked(some)).collect() == []
    index.build(some, 2)
    assert index.search(_asked(none)).collect() == []
    assert [(r["vec_id"], r["compared"]) for r in index.search(_asked(some).where("query_id = 1"), 1, exclude_self=True).collect()] == [(2, 2)]
    only = some.where("vec_id = 1")
    index.build(only, 2)
    assert index.search(_asked(only), 3, exclude_self=True).collect() == []


def test_centres_are_of_distinct_vectors():
    assert len(fitted_centres(np.array([[1.0, 0.0]] * 5), 3)) == 1
    assert len(fitted_centres(np.zeros((0, 2)), 3)) == 0

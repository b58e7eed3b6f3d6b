"""What a pruned search exchanges where nothing can be skipped."""

import random

from foliant.operators.pruned import PrunedIndex


def _shuffled(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_queries_are_not_exchanged_for_each_cell(spark, tmp_path):
    rng = random.Random(5)
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)], "vec_id long, embedding array<double>")
    index = PrunedIndex(spark, f"{tmp_path}/index", cells=64)
    index.build(table, 16)
    before = _shuffled(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        found = index.search(table.withColumnRenamed("vec_id", "query_id"), 5, exclude_self=True)
        assert found.count() == 15000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = _shuffled(spark) - before
    assert moved < 8_000_000, moved  # the vectors have 384,000 bytes; there are 64 cells

"""Column picking and tables in the shared folder."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import common


def test_pick_takes_columns_by_place(spark):
    frame = spark.range(2).select(F.col("id").alias("DOC_ID"), (F.col("id") + 10).alias("doc_id"), F.lit("a").alias("x"), F.lit("b").alias("x"))
    assert [tuple(r) for r in common.pick(frame, "doc_id", "x").orderBy("doc_id").collect()] == [(10, "a"), (11, "a")]
    assert common.pick(spark.range(1).toDF("Text"), "text").columns == ["text"]
    with pytest.raises(ValueError, match="no column"):
        common.pick(frame, "text")


def test_stored_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(common._CLEAN, None)
    table = common.stored(spark.range(50).repartition(3), "t")
    assert table.count() == 50 and spark.conf.get(common._CLEAN, None) == before
    assert common.stored(spark.range(0), "t").count() == 0
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

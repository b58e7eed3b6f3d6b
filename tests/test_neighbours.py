"""Rows before and running sums over blocks equal those of plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators.neighbours import with_previous, with_running_sum

SCHEMA = "g string, at long, v int, text string"


def _frame(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, 1, 2, -3]), rng.choice([None, "x", "y"])) for i in rng.sample(range(-500, 4000), 900)]
    return spark.createDataFrame([*rows, ("b", None, 5, "first"), ("one", 7, None, None)], SCHEMA)


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_equal_to_plain_windows(spark, width):
    df = _frame(spark)
    order = Window.partitionBy("g").orderBy(F.asc_nulls_first("at"))
    want = df.select("*", F.lag(F.struct("v", "text")).over(order).alias("p"), F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"))
    got = with_running_sum(with_previous(df, "g", "at", ["v", "text"], "p", width), "g", "at", "v", "s", width)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert with_previous(df, "g", "at", ["v"]).collect() == [] and with_running_sum(df, "g", "at", "v").collect() == []


def test_rows_of_a_group_are_in_many_blocks(spark, capsys):
    with_running_sum(_frame(spark), "g", "at", "v").explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(g" in plan and "_block" in plan and "NestedLoop" not in plan

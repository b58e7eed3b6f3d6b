"""Chunk rows make the chunks of a text once, and the recursive strategy searches instead of folding."""

import random

import pytest
from pyspark.sql import functions as F
from test_chunking import run, spec_recursive

from foliant.functions.text import SPACE, strip
from foliant.operators import chunking


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("strategy", ["recursive", "sentence"])
def test_no_filter_makes_the_chunks_again(spark, tmp_path, strategy):
    spark.createDataFrame([(1, "a. B"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    rows = chunking.chunk_rows(spark.read.parquet(f"{tmp_path}/in"), strategy=strategy)
    assert not [line for line in optimized(rows).splitlines() if "Filter" in line and "CASE" in line]
    if strategy == "sentence":
        assert optimized(rows).count("split(") == 1
    assert [(r["doc_id"], r["total_chunks"], r["chunk_index"], r["chunk_text"]) for r in rows.collect()] == [(1, 1, 0, "a. B")]


def test_runs_of_line_feeds_are_cut_as_by_a_split(spark):
    random.seed(5)
    parts = ["\n", "\n\n", "\n\n\n", "\n\n\n\n\n", " ", ". ", "ab", "漢字", "\U0001f600x", "y" * 30, "\x1c", "　"]
    rows = ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(300)]
    got = run(spark, rows, chunking.recursive_chunks("t", 20, 0))
    for row, chunks in zip(rows, got, strict=True):
        if len(row) > 20:
            assert chunks == spec_recursive(row, 20, list(chunking.SEPARATORS)), row


def test_strip_takes_what_the_pattern_takes(spark):
    rows = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["", " ", " 　\t", "x"]
    old = F.regexp_replace(F.col("t"), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    assert frame.where(~strip("t").eqNullSafe(old)).count() == 0

"""The key terms of a question are made once, not for each sentence of the document."""

import time

from pyspark.sql import functions as F

from foliant.operators.generation import extractive_answer


def test_long_questions_and_documents(spark):
    question = " ".join(f"question{i}" for i in range(20_000))
    content = " ".join(f"Sentence number {i} speaks of nothing." for i in range(1500)) + " Here question7 and question8 meet."
    rows = spark.createDataFrame([(question, [(1, content)])], "question string, docs array<struct<rank:int,content:string>>")
    began = time.time()
    assert rows.select(extractive_answer(F.col("question"), F.col("docs"))).first()[0] == "Here question7 and question8 meet."
    assert time.time() - began < 15

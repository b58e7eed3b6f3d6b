"""Context assembly and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.sentences import sentences
from foliant.functions.terms import key_terms
from foliant.functions.text import let

# What a prompt and a fixed answer look like.
BLANK_ANSWER = "Please provide a valid question."


def context_block(docs: Column) -> Column:
    """Documents of an array of struct(rank, content, source), in order, as numbered blocks with their sources."""
    part = lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(" (from "), F.coalesce(d["source"], F.lit("unknown")), F.lit("):\n"), F.coalesce(d["content"], F.lit("")))
    return F.array_join(F.transform(docs, part), "\n\n")


def contexts(docs: DataFrame) -> DataFrame:
    """(query_id, docs, context) of rows (query_id, rank, content, source)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "content", "source")))
    return docs.groupBy("query_id").agg(items.alias("docs")).withColumn("context", context_block(F.col("docs")))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n---\n"), context, F.lit("\n---\n\nQuestion: "), question)


def extractive_answer(question: Column, docs: Column) -> Column:
    """The sentence of the first document that shares most key terms with the question, the first of equals; null without one."""
    items = sentences(F.get(docs, F.lit(0))["content"])
    scored = let(key_terms(question), lambda asked: F.transform(items, lambda s, i: F.struct((-F.size(F.array_intersect(asked, key_terms(s)))).alias("n"), i.alias("i"), s.alias("s"))))
    return F.array_min(scored)["s"]


def listed_answer(docs: Column) -> Column:
    """A fixed answer that lists documents of struct(rank, id, source, score), scores with four places."""
    line = lambda d, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.coalesce(d["id"].cast("string"), F.lit("unknown")), F.lit(" (score: "), F.when(d["score"].isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", d["score"])), F.lit(") from "), F.coalesce(d["source"], F.lit("unknown")))
    lines = F.when(F.size(docs) > 0, F.array_join(F.transform(docs, line), "\n")).otherwise(F.lit("  No documents retrieved"))
    return F.concat(F.lit("Based on "), F.size(docs).cast("string"), F.lit(" retrieved documents:\n"), lines)


def with_fallback(answer: Column, question: Column, docs: Column) -> Column:
    """The answer, or a note of how many documents were found for the question."""
    return F.coalesce(answer, F.concat(F.lit("No answer could be generated. "), F.size(docs).cast("string"), F.lit(" documents were found for: "), question))

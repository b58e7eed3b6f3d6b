"""Retrieval, reranking and citation over rows (query_id, rank, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.terms import key_terms
from foliant.functions.text import is_blank, let

#: Candidates asked for when a reranker follows, results returned, and the score of what was not judged.
CANDIDATES, RESULTS, NEUTRAL = 20, 5, 0.5
#: Characters of a document that a scorer sees.
SCORED_CHARS = 500
UNKNOWN_SOURCE = "unknown_source"


def width(reranked: bool, candidates: int = CANDIDATES, results: int = RESULTS) -> int:
    return candidates if reranked else results


def retrieved(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """Hits (query_id, rank, vec_id, score) with content and source of ``payload`` (vec_id, text, source).

    Texts join after the top k is known, so that they never travel with the vectors.
    """
    return hits.join(payload.select("vec_id", F.col("text").alias("content"), "source"), "vec_id", "left").select("query_id", "rank", F.col("vec_id").alias("id"), "content", "source", "score")


def lexical_score(question: Column, content: Column) -> Column:
    """The share of the question's key terms in the first characters of the document; neutral without key terms."""
    return terms_score(key_terms(question), content)


def terms_score(asked: Column, content: Column) -> Column:
    """``lexical_score`` of a question whose key terms are known, which spares them for each candidate."""
    shared = F.size(F.array_intersect(asked, key_terms(F.substring(content, 1, SCORED_CHARS))))
    return F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(NEUTRAL))


def reranked(docs: DataFrame, top_k: int = RESULTS, min_score: float = 0.0, score: Column | None = None) -> DataFrame:
    """The best ``top_k`` of each query by ``score``, equal ones in their order before; rank is the new place.

    ``docs`` has query_id, question, rank and content. A blank question leaves the first ``top_k`` as they are. A null
    score is a failed judgement of the query: all its documents get the neutral score, no threshold applies,
    and they stay in order. The threshold applies only if it is positive.
    """
    value = lexical_score(F.col("question"), F.col("content")) if score is None else score
    rows = docs.withColumn("_s", value)
    query = Window.partitionBy("query_id")
    rows = rows.withColumn("_failed", F.max(F.col("_s").isNull()).over(query)).withColumn("_blank", is_blank("question"))
    rows = rows.withColumn("rerank_score", F.when(F.col("_blank"), F.lit(None).cast("double")).when(F.col("_failed"), F.lit(NEUTRAL)).otherwise(F.col("_s")))
    if min_score > 0:
        rows = rows.where(F.col("_blank") | F.col("_failed") | (F.col("rerank_score") >= min_score))
    place = query.orderBy(F.desc_nulls_last("rerank_score"), F.asc("rank"))
    ranked = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= top_k)
    return ranked.withColumn("rank", F.col("_place")).drop("_place", "_s", "_failed", "_blank")


def reranked_together(docs: DataFrame, top_k: int, min_score: float, scores: Callable[[Column, Column], Column]) -> DataFrame:
    """As ``reranked``, by ``scores`` (question, contents in their order) of all candidates of a query at once.

    The candidates of a query are gathered in one row, of which there are as many as were retrieved for it, and the scores are
    spread over them again. A null array, or a null score in it, is a failed judgement.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", F.struct(*docs.columns).alias("_row"))))
    asked = docs.groupBy("query_id").agg(F.first("question").alias("_question"), items.alias("_items"))
    judged = asked.withColumn("_scores", scores(F.col("_question"), F.transform("_items", lambda x: x["_row"]["content"])))
    rows = judged.select("_scores", F.posexplode("_items").alias("_at", "_item")).select("_item._row.*", F.get("_scores", F.col("_at")).alias("_given"))
    return reranked(rows, top_k, min_score, F.col("_given")).drop("_given")


# Shapes in which a judge may state scores if it does not give JSON, tried in order.
SCORE_SHAPES = (
    r"(?i)Document\s*(\d+)[:\s]+(\d+(?:\.\d+)?)",
    r"(?i)\[Document\s*(\d+)\][:\s]+(\d+(?:\.\d+)?)",
    r'"(\d+)":\s*(\d+(?:\.\d+)?)',
    r"(\d+)\s*[=:]\s*(\d+(?:\.\d+)?)",
)


def _tenth(score: Column) -> Column:
    """A score out of ten as 0 to 1; null stays null."""
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 10.0)))


def parsed_scores(response: Column, n: Column) -> Column:
    """Scores 0 to 1 of documents 1 to ``n`` from a judge's text: JSON of number to score out of ten, or the shapes above.

    Numbers out of range and values that are no numbers are left out; the last value of a document counts; one
    without a value gets the neutral score.
    """
    kind = "array<struct<i:int,v:double>>"
    braces = F.regexp_extract(response, r"(\{[^{}]+\})", 1)
    table = F.from_json(braces, "map<string,string>", {"mode": "PERMISSIVE"})
    valid = lambda items: F.filter(items, lambda x: x["i"].isNotNull() & x["v"].isNotNull() & (x["i"] >= 1) & (x["i"] <= n))
    as_item = lambda i, v: F.struct(F.trim(i).try_cast("int").alias("i"), _tenth(F.trim(v).try_cast("double")).alias("v"))
    found = valid(F.coalesce(F.transform(F.map_entries(table), lambda e: as_item(e["key"], e["value"])), F.array().cast(kind)))
    rest = F.array().cast(kind)
    for shape in reversed(SCORE_SHAPES):
        first, second = (F.regexp_extract_all(response, F.lit(shape), g) for g in (1, 2))
        rest = F.when(F.size(first) > 0, valid(F.zip_with(first, second, as_item))).otherwise(rest)
    items = F.when(F.size(found) > 0, found).otherwise(rest)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    value = lambda xs, k: F.coalesce(F.try_element_at(F.filter(xs, lambda x: x["i"] == k), F.lit(-1))["v"], F.lit(NEUTRAL))
    return let(items, lambda xs: F.transform(places, lambda k: value(xs, k)))


def ordered_sources(docs: DataFrame) -> DataFrame:
    """(query_id, sources): distinct sources in the order of rank; a missing one has a name of its own."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(UNKNOWN_SOURCE))
    items = F.array_sort(F.collect_list(F.struct("rank", source.alias("source"))))
    return docs.groupBy("query_id").agg(F.array_distinct(F.transform(items, lambda x: x["source"])).alias("sources"))

"""How well retrieval does, by source, by language and in all, run by run.

    python -m jobs.retrieval_report --questions PATH --vectors PATH --documents PATH --out PATH --run NAME [--config PATH]

Every question (vec_id, label, embedding) is searched among all vectors (vec_id, label, embedding); vectors of the question's label
are relevant. OUT/questions has the metrics of each question and OUT/report those of groups of questions, with the
distribution of their best scores and the change against the run before; both have a partition for each run. A run that is
repeated replaces its own partition and gives the same rows; names of runs are compared as text, so that dates do well.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import knn
from foliant.operators import retrieval_metrics as ret
from jobs.common import overwrite_partitions, read_config, read_written, session

log = logging.getLogger("jobs.retrieval_report")

QUESTIONS = "query_id bigint, source string, lang string, recall_at_k double, precision_at_k double, hit_rate double, mrr double, num_retrieved bigint, num_relevant bigint, best double, run string"
REPORT = (
    "source string, lang string, queries bigint, misses bigint, recall_at_k double, precision_at_k double, hit_rate double, mrr double, "
    "best_avg double, best_min double, best_bins array<bigint>, recall_change double, run string, level string"
)


@dataclass(frozen=True)
class Config:
    top_k: int = 5
    #: Best scores from 0 to 1 are counted in so many bins of one width; what lies below 0 counts in the first.
    bins: int = 10


def question_metrics(questions: DataFrame, vectors: DataFrame, documents: DataFrame, how: Config) -> DataFrame:
    """One row for each question that finds anything. Documents name the source and language of questions by their id.

    Ids name one vector each; of labels of a repeated one the least counts. A question is not among its own hits. Null labels are relevant to nothing; a question without a document has the source
    and the language null. Relevant sets are counted by label and never listed.
    """
    asked = questions.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = knn.top_k(asked, vectors, how.top_k, exclude_self=True)
    label_of = lambda rows, name, label: rows.groupBy(F.col("vec_id").alias(name)).agg(F.min("label").alias(label))
    own, other = label_of(questions, "query_id", "_own"), label_of(vectors, "vec_id", "_label")
    flagged = hits.join(own, "query_id").join(other, "vec_id").select("query_id", "rank", F.col("vec_id").alias("id"), "score", F.coalesce(F.col("_own") == F.col("_label"), F.lit(False)).alias("relevant"))
    sizes = vectors.groupBy(F.col("label").alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    among = vectors.select(F.col("vec_id").alias("query_id")).distinct().withColumn("_self", F.lit(1))
    relevant = own.join(sizes, "_own").join(among, "query_id", "left").select("query_id", (F.col("_n") - F.coalesce("_self", F.lit(0))).alias("num_relevant"))
    best = hits.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"))
    kinds = documents.select(F.col("doc_id").alias("query_id"), "source", "lang").groupBy("query_id").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    made = ret.flagged_metrics(flagged, relevant, how.top_k).join(best, "query_id").join(kinds, "query_id", "left")
    return made.select("query_id", "source", "lang", *ret.METRICS, "num_retrieved", "num_relevant", "best")


def grouped(questions: DataFrame, how: Config) -> DataFrame:
    """Averages for each source and language, source, language, and all questions, in one pass over the questions."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(how.bins - 1), F.floor(F.col("best") * how.bins)))
    bins = F.array(*(F.count_if(bin_of == i) for i in range(how.bins)))
    sets = questions.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang")
    made = sets.agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("queries"), F.count_if(F.col("hit_rate") == 0).alias("misses"), *(F.round(F.avg(m), 9).alias(m) for m in ret.METRICS),
        F.round(F.avg("best"), 6).alias("best_avg"), F.min("best").alias("best_min"), bins.alias("best_bins"),
    )
    level = F.element_at(F.array(*map(F.lit, ("source and language", "source", "language", "all"))), F.col("_set").cast("int") + 1)
    return made.withColumn("level", level).drop("_set")


def retrieval_report(spark: SparkSession, questions: str, vectors: str, documents: str, out: str, run: str, how: Config = Config()) -> dict[str, int]:
    """Writes the metrics and the report of one run; what was read and written is logged and returned."""
    out = out.rstrip("/")
    columns = ("vec_id", "label", "embedding")
    asked, found = (spark.read.parquet(p).select(*columns).where("vec_id is not null") for p in (questions, vectors))
    made = question_metrics(asked, found, spark.read.parquet(documents), how).withColumn("run", F.lit(run))
    overwrite_partitions(made, f"{out}/questions", "run")
    own = read_written(spark, f"{out}/questions", QUESTIONS).where(F.col("run") == run)
    # The run before is the last one that comes before this name, so that repeating a run compares it with the same one.
    earlier = read_written(spark, f"{out}/report", REPORT).where(F.col("run") < run)
    before = earlier.join(earlier.agg(F.max("run").alias("run")), "run").select("level", "source", "lang", F.col("recall_at_k").alias("_before"))
    rows = grouped(own, how).alias("r").join(before.alias("b"), F.expr("r.level = b.level and r.source <=> b.source and r.lang <=> b.lang"), "left")
    rows = rows.select("r.*", F.round(F.col("recall_at_k") - F.col("_before"), 9).alias("recall_change"), F.lit(run).alias("run"))
    overwrite_partitions(rows.select(*(c.split()[0] for c in REPORT.split(", "))), f"{out}/report", "run", "level")
    report = {"questions": own.count(), "groups": read_written(spark, f"{out}/report", REPORT).where(F.col("run") == run).count()}
    log.info("read %s against %s; wrote metrics of %d questions and %d groups as run %s to %s", questions, vectors, report["questions"], report["groups"], run, out)
    return report


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("questions", "vectors", "documents", "out", "run"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = session("retrieval_report")
    try:
        how = read_config(spark, given.config, Config) if given.config else Config()
        retrieval_report(spark, given.questions, given.vectors, given.documents, given.out, given.run, how)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

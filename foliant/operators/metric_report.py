"""Reports of retrieval metrics by tenant, source and total, from partial results that can be merged.

Partial results hold counts, sums and a KLL sketch of scores for each group. Those of several runs are put together by a
union, and no question is looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.retrieval_metrics import METRICS

#: The size of a sketch: up to as many scores its quantiles are exact, and beyond that their ranks are off by less than about 1 %.
SKETCH = 400
QUANTILES = (0.1, 0.5, 0.9)


def partials(per_query: DataFrame, keys: Sequence[str] = ("tenant", "source"), score: str = "score", sketch: int = SKETCH) -> DataFrame:
    """One row for each group of ``keys``: queries, misses, sums of the metrics, and of the scores least, greatest and sketch.

    ``per_query`` has a row for each question with ``keys``, the metrics and ``score``. Null keys are groups of their own; null metrics
    count as 0; scores that are null or not finite are in no sketch.
    """
    value = F.col(score).cast("double")
    usable = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    rows = per_query.select(*keys, *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in METRICS), usable.alias("_v"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("hit_rate") == 0).alias("misses"),
        *(F.sum(m).alias(m) for m in METRICS),
        F.min("_v").alias("score_min"),
        F.max("_v").alias("score_max"),
        F.count("_v").alias("scored"),
        F.kll_sketch_agg_double("_v", sketch).alias("sketch"),
    )


def report(parts: DataFrame, keys: Sequence[str] = ("tenant", "source"), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Groups of all ``keys``, of each key and of everything (``level``: all keys, the key's name, total), from partial results of any number of runs.

    Averages weigh each question alike. Quantiles are null where there is no score. Without partial results there are no rows.
    """
    sets = [list(keys), *([k] for k in keys), []] if len(keys) > 1 else [list(keys), []]
    grouped = parts.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    made = grouped.agg(
        F.grouping_id().alias("_set"),
        *(F.sum(c).alias(c) for c in ("queries", "misses", "scored")),
        *((F.sum(m) / F.sum("queries")).alias(m) for m in METRICS),
        F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"),
        F.kll_merge_agg_double(F.when(F.col("scored") > 0, F.col("sketch"))).alias("_sketch"),
    )
    # a bit of the grouping id is set where the key of its place, from the left, is left out
    number = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    level = F.lit(None).cast("string")
    for s in sets:
        name = "total" if not s else s[0] if len(s) == 1 else "all keys"
        level = F.when(F.col("_set") == number(s), F.lit(name)).otherwise(level)
    at = F.array(*(F.lit(float(q)) for q in quantiles))
    return made.select(level.alias("level"), *keys, "queries", "misses", *METRICS, "scored", "score_min", "score_max", F.when(F.col("scored") > 0, F.kll_sketch_get_quantile_double("_sketch", at)).alias("quantiles"))

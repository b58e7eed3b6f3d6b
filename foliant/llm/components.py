"""Connected components of an edge table, by hooking and pointer jumping in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node on an edge: label is the smallest node id reachable.

    ``edges`` has long columns a and b; direction, repeats and loops do not matter, edges with a null
    end are ignored, and no edges give no rows. Every round hooks the current roots on the smallest
    label seen across an edge and then halves the paths to the roots, so the number of rounds grows
    with the logarithm of the longest path. The state of a round is a written table in the shared
    folder. All steps are joins and minimum aggregates with partial aggregation: a hub of any degree
    is combined before the shuffle. Raises RuntimeError if ``rounds`` are not enough.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label"))
    last = label = stored(label, "labels")
    for _ in range(rounds):
        of_b = label.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
        of_a = label.select(F.col("node").alias("a"), F.col("label").alias("_la"))
        seen = both.join(of_b, "b").join(of_a, "a").where("_lb < _la")
        lower = seen.select(F.explode(F.array("a", "_la")).alias("node"), "_lb").groupBy("node").agg(F.min("_lb").alias("_new"))
        hooked = label.join(lower, "node", "left").select("node", F.least("label", F.coalesce("_new", "label")).alias("label"), "_new")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), (F.col("_new").isNotNull() | (F.col("_up") < F.col("label"))).alias("_moved"))
        before, last = last, stored(new, "labels")
        discard(before)
        label = last.select("node", "label")
        if last.where("_moved").isEmpty():
            discard(both)
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")

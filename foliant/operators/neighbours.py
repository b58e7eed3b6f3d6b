"""Rows in order within groups of any size: the row before, and running sums.

A window over a group puts the whole group in one task. Here a group is cut into blocks of its order, windows run over blocks, and what
a block hands to the next one is one row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that one block spans.
WIDTH = 65_536


def _blocks(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))


def _joined(rows: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    same = F.col("a._block").eqNullSafe(F.col("b._block")) & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))
    return rows.alias("a").join(edges.alias("b"), same, "left").select("a.*", "b._before").drop("_block")


def with_previous(df: DataFrame, group: str, order: str, columns: Sequence[str], name: str = "previous", width: int = WIDTH) -> DataFrame:
    """``df`` with a struct of ``columns`` of the row before in the group, null for the first one.

    ``order`` is a whole number, unique in its group; a null one comes first. Null groups are one group. Names that begin with an
    underscore are taken.
    """
    held = F.struct(*columns)
    rows = _blocks(df, order, width)
    by_order = Window.partitionBy(group, "_block").orderBy(F.asc_nulls_first(order))
    inside = rows.withColumn("_inside", F.lag(held).over(by_order))
    last = rows.groupBy(group, "_block").agg(F.max_by(held, F.struct(F.col(order).isNotNull(), order)).alias("_last"))
    edges = last.select(group, "_block", F.lag("_last").over(Window.partitionBy(group).orderBy(F.asc_nulls_first("_block"))).alias("_before"))
    # the first row of a block is the one that has none before it there
    return _joined(inside, edges, group).withColumn(name, F.coalesce("_inside", "_before")).drop("_inside", "_before")


def with_running_sum(df: DataFrame, group: str, order: str, value: str, name: str = "running", width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers; null: 0) over its group up to each row; as for ``order`` see ``with_previous``."""
    number = F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))
    rows = _blocks(df, order, width)
    by_order = Window.partitionBy(group, "_block").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_inside", F.sum(number).over(by_order))
    whole = rows.groupBy(group, "_block").agg(F.sum(number).alias("_whole"))
    earlier = Window.partitionBy(group).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = whole.select(group, "_block", F.sum("_whole").over(earlier).alias("_before"))
    return _joined(inside, edges, group).withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_inside", "_before")

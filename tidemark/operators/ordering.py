"""Positions and neighbours in long orders, without one task holding a whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_position(df: DataFrame, order: list[Column], chunk: Column, descending: bool, name: str) -> DataFrame:
    """1-based position of each row in one total order.

    ``chunk`` is a coarse, monotone image of the order (a month for a time). Rows are ranked
    inside their chunk in parallel; only the per-chunk counts meet in one place.
    """
    keyed = df.withColumn("_chunk", chunk)
    by_chunk = F.desc("_chunk") if descending else F.asc("_chunk")
    counts = keyed.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(by_chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        keyed.withColumn("_inside", inside)
        .join(offsets, "_chunk")
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_chunk", "_inside", "_offset")
    )


def previous_in_key(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column, name: str
) -> DataFrame:
    """Struct ``name`` with ``values`` of the preceding row of the same key, NULL for the first.

    A key may own any share of the rows: the window runs per (key, chunk), and the first row of
    a chunk takes the last row of the key's previous non-empty chunk, found on chunk summaries.
    """
    keyed = df.withColumn("_chunk", chunk).withColumn("_value", F.struct(*values))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    last = keyed.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = last.select(*keys, "_chunk", F.lag("_last").over(across).alias("_carried"))
    return (
        keyed.withColumn("_lag", F.lag("_value").over(inside))
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_lag", "_carried"))
        .drop("_chunk", "_value", "_lag", "_carried")
    )


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], count: int = 1, name: str = "rank") -> DataFrame:
    """The ``count`` first rows per key.

    Spark turns the rank filter into a per-task limit before the shuffle, so a key with a third
    of the table sends at most ``count`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= count)

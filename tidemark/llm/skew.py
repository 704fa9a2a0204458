"""Joins of rows with facts about their class, where one class may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # classes with more than 1/HOT of all rows meet their rows by broadcast: they are fewer than HOT


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``classes``, one row for each value of the (never null) ``keys``.

    ``size`` names the column with the number of rows of a class. The largest classes, fewer than ``HOT`` by their
    size, are broadcast, so that their rows stay where they are; all others are joined by key.
    """
    bound = rows.count() / HOT
    hot = F.broadcast(classes.where(F.col(size) > bound))
    cold = classes.where(F.col(size) <= bound)
    others = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return rows.join(hot, keys).unionByName(others)

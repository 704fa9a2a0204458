"""Equality of two tables as multisets of rows, and where they differ.

A row is two independent 64-bit hashes of all its columns (a null is not an empty value). The fingerprint of a set of
rows is their number and the sums of the halves of these hashes, so it adds up over tasks and parts in any order, and
copies count. Rows belong to ranges of a hash of their key: ``WIDTH`` ranges on the first level, each split into as many
on the next. Ranges with equal fingerprints are done with; the rows of the others are compared one by one. Both
tables are read once for each level, and only differing ranges shuffle rows.

Columns of map type have no hash and are an error. A sum is exact up to two thousand million rows in a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .snapshots import table_difference

WIDTH = 256
SUMS = ("rows", "a_low", "a_high", "b_low", "b_high")


def _row_hash(columns: list[str], seed: int) -> Column:
    # a null leaves a hash as it was, so every column is followed by whether it is null
    parts = [p for c in columns for p in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def _sums(columns: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for name, seed in (("a", 1), ("b", 2)):
        h = _row_hash(columns, seed)
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{name}_high")]
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of rows and the four sums of a table."""
    return df.agg(*_sums(sorted(df.columns)))


def _range(keys: list[str], level: int) -> Column:
    """The range of a row on a level: the leading bits of the hash of its key."""
    bits = (WIDTH.bit_length() - 1) * level
    return F.shiftrightunsigned(_row_hash(keys, 3), 64 - bits)


def differing_ranges(left: DataFrame, right: DataFrame, keys: list[str], level: int = 1, within: DataFrame | None = None) -> DataFrame:
    """(range, left_rows, right_rows) of the ranges of a level whose fingerprints differ; ``within`` are those of the level above."""
    columns = sorted(left.columns)

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.select(*columns)
        if within is not None:
            df = df.withColumn("_above", _range(keys, level - 1)).join(F.broadcast(within.select(F.col("range").alias("_above"))), "_above", "left_semi")
        sums = df.groupBy(_range(keys, level).alias("range")).agg(*_sums(columns))
        return sums.select("range", F.lit(name).alias("side"), *SUMS)

    both = side(left, "left").unionByName(side(right, "right"))
    # at most one row for each side and range
    signed = [F.sum(F.when(F.col("side") == "left", F.col(c)).otherwise(-F.col(c))).alias(f"d_{c}") for c in SUMS]
    counts = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("rows"))), F.lit(0)).alias(f"{s}_rows") for s in ("left", "right")]
    found = both.groupBy("range").agg(*signed, *counts)
    return found.where(reduce(lambda a, b: a | b, [F.col(f"d_{c}") != 0 for c in SUMS])).select("range", "left_rows", "right_rows")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose number of copies differs, with both numbers, found by way of the ranges that differ on two levels.

    ``keys`` only decide which rows share a range; they need not be unique.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("column lists differ")
    first = staged(differing_ranges(left, right, keys), "ranges")  # WIDTH rows at most
    second = staged(differing_ranges(left, right, keys, 2, first), "ranges")  # WIDTH ** 2 rows at most

    def rest(df: DataFrame) -> DataFrame:
        placed = df.select(*left.columns, _range(keys, 2).alias("_range"))
        return placed.join(F.broadcast(second.select(F.col("range").alias("_range"))), "_range", "left_semi").drop("_range")

    return table_difference(rest(left), rest(right))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, by the file system's own count."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength())


def verify_rows(history: dict[str, DataFrame], hot: dict[str, DataFrame]) -> DataFrame:
    """(table_name, history, hot, equal, same_rows) of every table: row counts, whether they agree, and whether the rows do.

    A table that one side lacks has no count there and is not equal.
    """
    parts = []
    for side, tables in (("history", history), ("hot", hot)):
        parts += [fingerprint(df).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), *SUMS) for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    by_side = [F.sum(F.when(F.col("side") == s, F.col("rows"))).alias(s) for s in ("history", "hot")]
    alike = reduce(lambda a, b: a & b, [F.min(F.coalesce(c, F.lit(0))).eqNullSafe(F.max(F.coalesce(c, F.lit(0)))) for c in SUMS])
    found = rows.groupBy("table_name").agg(*by_side, alike.alias("alike"))
    equal = F.col("history").eqNullSafe(F.col("hot"))
    return found.select("table_name", "history", "hot", equal.alias("equal"), (equal & F.col("alike")).alias("same_rows"))


def size_ratio(spark: SparkSession, history: str, hot: str) -> DataFrame:
    """(history_bytes, hot_bytes, size_ratio) of two stored generations; one row."""
    a, b = folder_bytes(spark, history), folder_bytes(spark, hot)
    return spark.createDataFrame([(a, b, round(b / max(1, a), 4))], "history_bytes long, hot_bytes long, size_ratio double")

"""Line-oriented documents: observation logs, target manifests, single inventory documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.documents import strict_inventory, strict_observation, strict_target
from ..session import dealt, staged

# Scan limits.
MAX_LINE_BYTES = 20 * 1024 * 1024
MAX_RECORDS = 100_000
MAX_TARGETS = 10_000
# End of fixed values.


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, seq)``: ``seq`` orders lines as they stand in their files.

    A split is read in order by one task, so (file, split start, running id) is file order
    without numbering the whole input.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add the 1-based ``line_no`` within each file.

    A file is read in as many byte ranges as its size asks for. One pass counts the lines of each range; the
    counts, one row for each range, are summed up in order; a second pass adds what came before to the place
    of a line in its range. Lines stay in the task that reads them: only the offsets travel.
    """
    keyed = lines.select("*", F.col("seq.block").alias("_block"), F.col("seq.row").alias("_row"))
    splits = keyed.groupBy("file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row for each spark.sql.files.maxPartitionBytes of input: a bound that the scan's plan has as well
    return (
        keyed.join(F.broadcast(offsets), ["file", "_block"])
        .withColumn("line_no", F.col("_offset") + F.col("_row") - F.col("_first") + 1)
        .select(*lines.columns, "line_no")
    )


def _split(lines: DataFrame, parser, max_line_bytes: int) -> DataFrame:
    parsed = dealt(lines).withColumn("doc", parser(F.col("value")))
    too_long = F.octet_length("value") > max_line_bytes
    return parsed.select(
        "seq",
        F.when(too_long, F.lit("line exceeds configured byte limit"))
        .otherwise(F.col("doc.error"))
        .alias("error"),
        "value",
        "doc",
    )


class RejectedLines(ValueError):
    """A strict scan met a line that is not acceptable."""


def accepted(parsed: DataFrame, strict: bool) -> DataFrame:
    """Rows without an error. A strict scan stops at the first rejected line, inside the job."""
    if strict:
        message = F.concat(F.lit("invalid line: "), F.col("error"))
        parsed = parsed.filter(F.when(F.col("error").isNotNull(), F.raise_error(message)).otherwise(True))
    else:
        parsed = parsed.filter(F.col("error").isNull())
    fields = [f for f in parsed.schema["doc"].dataType.names if f != "error"]
    return parsed.select("seq", *[F.col(f"doc.{f}").alias(f) for f in fields])


def rejected(parsed: DataFrame) -> DataFrame:
    """(seq, error, value) of the rows that ``accepted`` leaves out."""
    return parsed.filter(F.col("error").isNotNull()).select("seq", "error", "value")


def scan_observations(spark: SparkSession, path: str, max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(valid observations, rejected lines) of a log; nothing is dropped silently."""
    parsed = parse_observations(read_lines(spark, path), max_line_bytes)
    return accepted(parsed, strict=False), rejected(parsed)


def parse_observations(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    return _split(lines.filter(F.col("value") != ""), strict_observation(), max_line_bytes)


def read_observations(
    spark: SparkSession,
    path: str,
    strict: bool = True,
    max_line_bytes: int = MAX_LINE_BYTES,
    max_records: int | None = None,
    max_targets: int | None = None,
) -> DataFrame:
    """Observation log. Empty lines are skipped; a rejected line fails a strict scan, and so does a limit that is exceeded.

    A log of any size is read where no limit is given; ``MAX_RECORDS`` and ``MAX_TARGETS`` are the usual ones.
    """
    rows = accepted(parse_observations(read_lines(spark, path), max_line_bytes), strict)
    if strict and (max_records is not None or max_targets is not None):
        rows = within_limits(rows, max_records, max_targets)
    return rows


def within_limits(observations: DataFrame, max_records: int | None, max_targets: int | None) -> DataFrame:
    """The observations; the job fails if there are more records or targets than allowed.

    Both numbers are one aggregate row that a scalar subquery brings to every task, so no row passes before they are known.
    The observations are written first: parsing a line costs far more than reading it back, and both need them.
    """
    observations = staged(observations, "limited")
    counts = observations.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("target_id").alias("targets"))
    problem = F.lit(None).cast("string")
    for name, limit, what in (("targets", max_targets, "target"), ("records", max_records, "record")):
        if limit is not None:
            problem = F.when(F.col(name) > limit, F.lit(f"history exceeds configured {what} limit")).otherwise(problem)
    found = counts.select(problem.alias("problem")).scalar()
    return observations.filter(F.when(found.isNotNull(), F.raise_error(found)).otherwise(F.lit(True)))


def read_targets(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    return accepted(_split(lines, strict_target(), MAX_LINE_BYTES), strict)


def read_documents(spark: SparkSession, path: str, kind: str = "inventory", strict: bool = True) -> DataFrame:
    """One observation or inventory per file, for a file or a folder of files."""
    whole = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("seq")
    )
    parser = strict_inventory() if kind == "inventory" else strict_observation()
    return accepted(_split(whole, parser, MAX_LINE_BYTES), strict)


def history_limits(
    observations: DataFrame, max_records: int = MAX_RECORDS, max_targets: int = MAX_TARGETS
) -> DataFrame:
    """One row: counts, and whether each stays within its limit."""
    return observations.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("target_id").alias("targets")
    ).select(
        "records",
        "targets",
        (F.col("records") <= max_records).alias("records_ok"),
        (F.col("targets") <= max_targets).alias("targets_ok"),
    )

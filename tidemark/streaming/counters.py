"""Run summaries kept up to date by four streams: runs, files, dependencies and findings.

Every batch of a stream folds to one increment for each run and is a folder of its own,
``log/<stream>/batch=N``. A summary is the sum of a run's increments; a run without details has a row of zeroes
from the stream of runs. The streams need no order among each other: a detail may come before its run, which is
shown once its own row is there, and any stream may lag behind.

A batch that is replayed replaces its folder. Compaction writes the sums of all batches up to a number for each stream
as one generation and says which numbers these are; the folders it covers may then go, and a batch of theirs that is
replayed later (a stream that broke off before its commit) writes a folder that readers leave out.

Batch numbers are those of the stream's checkpoint: one checkpoint belongs to one log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summaries import COUNTERS, detail_deltas
from ..session import remove
from ..sinks.publish import _path, current_generation, publish_generation

STREAMS = ("runs", "files", "dependencies", "findings")


def increments(kind: str, rows: DataFrame) -> DataFrame:
    """(analysis_run_id, the counters) of some rows of one stream: one row for each run."""
    if kind == "runs":
        zeroes = [F.lit(0).cast("bigint").alias(c) for c in COUNTERS]
        return rows.select(F.col("id").alias("analysis_run_id"), *zeroes).dropDuplicates(["analysis_run_id"])
    parts = {"findings": None, "files": None, "dependencies": None}
    if kind not in parts:
        raise ValueError(f"no stream of {kind}")
    return detail_deltas(**{**parts, kind: rows})


def keep_counters(kind: str, rows: DataFrame, log: str, checkpoint: str) -> None:
    """Fold all rows that a stream has now into the log."""

    def write(batch: DataFrame, number: int) -> None:
        increments(kind, batch).write.mode("overwrite").parquet(f"{log}/{kind}/batch={number}")

    increments(kind, rows.sparkSession.createDataFrame([], rows.schema))  # an unknown stream fails before it starts
    (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _batches(spark: SparkSession, log: str) -> dict[tuple[str, int], str]:
    """The folders of finished batches: a batch being written has no marker yet."""
    pattern, fs = _path(spark, f"{log}/*/batch=*/_SUCCESS")
    folders = [s.getPath().getParent() for s in (fs.globStatus(pattern) or [])]
    return {(f.getParent().getName(), int(f.getName().split("=")[1])): f.toString() for f in folders}


def _compacted(spark: SparkSession, log: str) -> tuple[str | None, dict[str, int]]:
    """(newest compaction, the last batch of each stream that it holds)."""
    generation = current_generation(spark, f"{log}/compacted")
    if generation is None:
        return None, {}
    return generation, {r.stream: r.last for r in spark.read.parquet(f"{generation}/covers").collect()}  # a row for each stream


def _read(spark: SparkSession, generation: str | None, batches: dict[tuple[str, int], str]) -> list[DataFrame]:
    """The rows of a compaction and of some batches, with ``known`` for those that the stream of runs brought."""
    parts = [spark.read.parquet(f"{generation}/counters")] if generation else []
    for kind in sorted({k for k, _ in batches}):
        rows = spark.read.parquet(*[path for (k, _), path in batches.items() if k == kind])
        parts.append(rows.withColumn("known", F.lit(kind == "runs")))
    return [p.select("analysis_run_id", *COUNTERS, "known") for p in parts]


def _merged(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("analysis_run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("known").alias("known"))


def counters(spark: SparkSession, log: str) -> DataFrame:
    """(analysis_run_id, the counters) of every run that the stream of runs has brought."""
    generation, covers = _compacted(spark, log)
    parts = _read(spark, generation, {k: p for k, p in _batches(spark, log).items() if k[1] > covers.get(k[0], -1)})
    if not parts:
        raise FileNotFoundError(f"no increments in {log}")
    return _merged(parts).where("known").drop("known")


def compact(spark: SparkSession, log: str) -> int:
    """Put all finished batches together in one generation and drop their folders; the number of folders it took in.

    Readers see the batches or the generation, never both or neither. One compaction of a log runs at a time. A stream's
    newest batch is left alone: it may be replayed while this runs.
    """
    newest: dict[str, int] = {}
    batches = _batches(spark, log)
    for kind, number in batches:
        newest[kind] = max(newest.get(kind, -1), number)
    generation, covers = _compacted(spark, log)
    taken = {k: p for k, p in batches.items() if covers.get(k[0], -1) < k[1] < newest[k[0]]}
    stale = [p for k, p in batches.items() if k[1] <= covers.get(k[0], -1)]
    if taken:
        for kind, number in taken:
            covers[kind] = max(covers.get(kind, -1), number)
        number = int(generation.rsplit("-", 1)[1]) + 1 if generation else 0
        held = spark.createDataFrame(sorted(covers.items()), "stream string, last long")
        publish_generation({"counters": _merged(_read(spark, generation, taken)), "covers": held}, f"{log}/compacted", f"counters-{number:08d}")
    for path in [*taken.values(), *stale]:
        remove(spark, path)
    return len(taken)

"""Streaming queries: each processes a table as a stream and equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports
from ..session import scratch
from ..streaming import counters, jobs, keyed_state
from . import views as v
from .import_queries import _bundle
from .queue_queries import _FINDING_NAMES, _FINDING_SQL
from .views import ORACLES, query, table, with_views


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _observations(events: DataFrame) -> DataFrame:
    tool = F.concat(F.lit('[{"name":"'), "event_type", F.lit('","definition":'), "props", F.lit("}]"))
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("target_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"),
        F.col("event_id").alias("seq"),
        tool.alias("inventory"),
    )


_TOP = """WITH r AS (SELECT 'user-' || user_id AS target_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, event_id, event_type, props,
  row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ') DESC, event_id DESC) AS rank FROM events),
p AS (SELECT a.target_id, a.at AS latest_at, a.event_id AS latest_seq, b.at AS previous_at, b.event_id AS previous_seq,
  CASE WHEN a.event_type <> b.event_type THEN 1 WHEN b.at IS NOT NULL THEN 0 END AS added, CASE WHEN a.event_type <> b.event_type THEN 1 WHEN b.at IS NOT NULL THEN 0 END AS removed,
  CASE WHEN a.event_type = b.event_type AND a.props <> b.props THEN 1 WHEN b.at IS NOT NULL THEN 0 END AS modified,
  CASE WHEN a.event_type = b.event_type AND a.props = b.props THEN 1 WHEN b.at IS NOT NULL THEN 0 END AS unchanged
  FROM r a LEFT JOIN r b ON b.target_id = a.target_id AND b.rank = 2 WHERE a.rank = 1)"""


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "top2")
    changes = jobs.latest_two_stream(_observations(_stream(spark, sf, "events")))
    jobs.run_to_end(changes, path, scratch(spark, "top2-state"), "update")
    return jobs.newest_states(spark, path)


@query("i12_streamed_latest_two", f"{_TOP} SELECT target_id, latest_at, latest_seq, previous_at, previous_seq FROM p")
def streamed_latest_two(spark: SparkSession, sf: str) -> DataFrame:
    return _finished(spark, sf).select("target_id", "latest_at", "latest_seq", "previous_at", "previous_seq")


@query("i13_streamed_drift_alerts", f"{_TOP} SELECT target_id, added, removed, modified, unchanged FROM p WHERE added + removed + modified > 0")
def streamed_drift_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.drift_alerts(_finished(spark, sf)).select("target_id", "added", "removed", "modified", "unchanged")


@query("i4_streamed_run_summaries", with_views(f"SELECT analysis_run_id, {_FINDING_SQL} FROM findings GROUP BY 1", "findings"))
def streamed_run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "counters")
    jobs.summarize_stream(v.findings_of(_stream(spark, sf, "lineitem")), path, scratch(spark, "counters-state"))
    return jobs.streamed_counters(spark, path).select("analysis_run_id", *_FINDING_NAMES)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "newest-two")
    # each file holds events of all times: most rows of the later batches come late
    keyed_state.run(keyed_state.newest_two(_observations(_table_stream(spark, sf, "events", 4))), path, scratch(spark, "newest-two-state"))
    return jobs.newest_states(spark, path)


@query("i12_keyed_state", ORACLES["i12_streamed_latest_two"])
def keyed_latest_two(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches with events of all times in each; the state keeps two entries of tool digests."""
    return _keyed(spark, sf).select("target_id", "latest_at", "latest_seq", "previous_at", "previous_seq")


@query("i13_keyed_state", ORACLES["i13_streamed_drift_alerts"])
def keyed_drift_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.drift_alerts(_keyed(spark, sf)).select("target_id", "added", "removed", "modified", "unchanged")


def _table_stream(spark: SparkSession, sf: str, name: str, files: int) -> DataFrame:
    """A table as a stream of several batches: its rows dealt to files, to each batch as many as its share of the scan has splits."""
    path = scratch(spark, f"{name}-stream")
    source = table(spark, sf, name)
    share = -(-source.rdd.getNumPartitions() // files)
    source.repartition(files * share).write.parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", share).parquet(path)


@query("i4_streamed_summaries", ORACLES["a7_i10_run_summaries"])
def streamed_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, files, dependencies and findings arrive as four streams of several batches; a compaction comes in between."""
    log = scratch(spark, "counters")
    streams = {
        "findings": v.findings_of(_table_stream(spark, sf, "lineitem", 3)),
        "files": v.files_of(_table_stream(spark, sf, "documents", 3)),
        "dependencies": v.dependencies_of(_table_stream(spark, sf, "supplier", 2)),
        "runs": v.runs_of(_table_stream(spark, sf, "customer", 2)).select("id"),
    }
    for kind, rows in streams.items():
        counters.keep_counters(kind, rows, log, scratch(spark, f"{kind}-state"))
        if kind == "dependencies":
            counters.compact(spark, log)
    return counters.counters(spark, log)


@query("i14_streamed_import", "SELECT 1 AS snapshot_id, count(*) AS members, count(DISTINCT p_partkey) AS identifiers FROM part")
def streamed_import(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle arrives, is imported by the stream, and imported again to no effect."""
    folder, root = scratch(spark, "arrivals"), scratch(spark, "catalog")
    _bundle(spark, sf, folder, 1)
    for attempt in ("first", "replay"):
        jobs.import_stream(spark, folder, root, scratch(spark, attempt), "2024-02-01T00:00:00Z")
    t = imports.read_catalog(spark, root)
    rows = t["snapshot_server_versions"].join(
        t["server_versions"].select(F.col("id").alias("server_version_id"), "server_identifier"), "server_version_id"
    )
    return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("server_identifier").alias("identifiers"))

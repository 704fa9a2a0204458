"""Fixture of the import queries and tests: a snapshot bundle made from table rows.

A bundle is what a collector leaves. Here its pages, cursors, response facts and times are made up, so that reading,
checking and importing it can be compared with SQL over the same rows. No operator uses this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import api_url
from ..operators.validation import snapshot_digest
from ..session import staged
from ..sinks.publish import _path, write_canonical
from ..sources.bundles import build_records, read_artifacts, unique_records
from ..sources.files import write_files


def write_pages(entries: DataFrame, root: str) -> None:
    """Raw pages from ``(page, position, entry)``: one file ``page=N`` with one document each.

    A page is one bounded response, so its entries may be joined in one group; a page names the
    next one unless it is the last.
    """
    last = entries.agg(F.max("page").alias("m")).scalar()
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda e: e["entry"]), ",")
    pages = entries.groupBy("page").agg(items.alias("items"))
    cursor = F.when(F.col("page") < last, F.concat(F.lit('"c/'), F.col("page").cast("string"), F.lit('"'))).otherwise("null")
    body = F.concat(F.lit('{"metadata":{"nextCursor":'), cursor, F.lit('},"servers":['), "items", F.lit("]}"))
    write_files(pages.select(F.concat(F.lit("page="), F.col("page").cast("string")).alias("name"), body.alias("body")), f"{root}/raw")


def write_bundle(
    entries: DataFrame, root: str, base: str, completed_at: str, updated_since: str | None = None, base_snapshot_sha256: str | None = None
) -> str:
    """Write a complete bundle; the marker file comes last. With ``updated_since`` it is an incremental one."""
    spark = entries.sparkSession
    write_pages(entries, root)
    write_canonical(unique_records(build_records(entries)), f"{root}/canonical/servers.jsonl")
    artifacts = staged(read_artifacts(spark, root), "artifacts")
    since = F.lit(updated_since).cast("string")
    number = F.regexp_extract("path", r"page=([0-9]+)", 1).cast("int")
    count = entries.groupBy(F.col("page").cast("int").alias("page_number")).agg(F.count(F.lit(1)).alias("records"))
    last = entries.agg(F.max("page").cast("int").alias("m")).scalar()
    index = artifacts.filter(F.startswith("path", F.lit("raw/"))).withColumn("page_number", number).join(count, "page_number")
    cursor_in = F.when(F.col("page_number") > 1, F.concat(F.lit("c/"), (F.col("page_number") - 1).cast("string")))
    cursor_out = F.when(F.col("page_number") < last, F.concat(F.lit("c/"), F.col("page_number").cast("string")))
    url = api_url(F.lit(base), cursor_in, since)
    index.select(
        "page_number",
        url.alias("request_url"),
        url.alias("effective_response_url"),
        F.lit(completed_at).alias("retrieved_at"),
        F.lit(200).alias("http_status"),
        F.lit("application/json").alias("content_type"),
        F.col("size").alias("response_bytes"),
        "sha256",
        cursor_in.alias("pagination_input"),
        cursor_out.alias("pagination_output"),
        F.lit(0).alias("redirect_count"),
        "records",
        "path",
    ).write.json(f"{root}/raw/pages.jsonl", ignoreNullFields=False)
    unique = spark.read.text(f"{root}/canonical/servers.jsonl").agg(F.count(F.lit(1)).alias("n")).scalar()
    # The manifest lists every file once; it has one entry per file by definition.
    listed = artifacts.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("artifacts"))
    totals = F.struct(
        last.cast("bigint").alias("pages"),
        entries.agg(F.count(F.lit(1)).alias("n")).scalar().alias("records_received"),
        unique.alias("unique_server_versions"),
    )
    listed.select(
        F.lit(2).alias("bundle_version"),
        F.lit("full" if updated_since is None else "incremental").alias("collection_mode"),
        since.alias("updated_since"),
        F.lit(base_snapshot_sha256).cast("string").alias("base_snapshot_sha256"),
        F.lit(base).alias("registry_base_url"),
        F.lit("complete").alias("status"),
        F.lit(completed_at).alias("started_at"),
        F.lit(completed_at).alias("completed_at"),
        snapshot_digest(artifacts).scalar().alias("snapshot_sha256"),
        totals.alias("counts"),
        "artifacts",
    ).coalesce(1).write.json(f"{root}/manifest.json")
    marker, fs = _path(spark, f"{root}/_SUCCESS")
    fs.create(marker, True).close()
    return root

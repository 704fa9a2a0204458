"""Set-level checks: bundles, page chains, orphans, domains, rule invariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents
from ..sources.bundles import record_digest
from ..sources.files import ordered_digest
from .ordering import previous_in_key


def outside_domain(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not in a closed domain (NULL is outside)."""
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def artifact_mismatches(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared files that are missing, or differ in size or digest."""
    a = actual.select("path", F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    joined = declared.join(a, "path", "left")
    problem = (
        F.when(F.col("actual_sha256").isNull(), "missing")
        .when(F.col("actual_size") != F.col("size"), "size")
        .when(F.col("actual_sha256") != F.col("sha256"), "digest")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def record_problems(records: DataFrame) -> DataFrame:
    """Canonical records with a parse error, other than canonical bytes, or a wrong digest."""
    canonical = documents.canonical_json()(F.col("canonical_json"))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~canonical.eqNullSafe(F.col("canonical_json")), F.lit("canonical record is not canonical JSON"))
        .when(
            record_digest("canonical_json") != F.col("record.canonical_sha256"),
            F.lit("canonical record digest mismatch"),
        )
    )
    return records.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def order_breaks(rows: DataFrame, file: str, line_no: str, identity: list[str], chunk_lines: int = 100_000) -> DataFrame:
    """Rows whose identity does not strictly follow the row before it in its file."""
    chunk = F.floor(F.col(line_no) / chunk_lines)
    before = previous_in_key(rows, [file], [line_no], identity, chunk, "before")
    here = F.struct(*identity)
    return before.filter(F.col("before").isNotNull() & (here <= F.col("before")))


def duplicate_identities(rows: DataFrame, identity: list[str]) -> DataFrame:
    return rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def conflicting_duplicates(rows: DataFrame, identity: list[str], body: Column) -> DataFrame:
    """Identities that occur with more than one content."""
    return (
        rows.groupBy(*identity)
        .agg(F.countDistinct(F.sha2(body, 256)).alias("variants"))
        .filter("variants > 1")
    )


def page_chain(pages: DataFrame, bundle: str, page: str, cursor_in: str, cursor_out: str) -> DataFrame:
    """Per bundle: numbering, continuity, repeated cursors and pages after the end.

    Page numbers are dense, so "the page before" is an equi-join on (bundle, page): rows of one
    bundle spread over all tasks, however many pages it has.
    """
    here = pages.select(
        F.col(bundle).alias("bundle"),
        F.col(page).alias("page"),
        F.col(cursor_in).alias("cursor_in"),
        F.col(cursor_out).alias("cursor_out"),
    )
    nxt = here.select("bundle", (F.col("page") + 1).alias("page"), F.col("cursor_out").alias("expected"), F.lit(True).alias("has_before"))
    linked = here.join(nxt, ["bundle", "page"], "left")
    first = F.col("page") == 1
    counted = linked.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.count_if(~first & F.col("has_before").isNull()).alias("gaps"),
        F.count_if(
            ~first & F.col("has_before").isNotNull() & F.col("expected").isNull()
        ).alias("after_terminal"),
        F.count_if(
            F.col("expected").isNotNull() & ~F.col("cursor_in").eqNullSafe(F.col("expected"))
        ).alias("broken_links"),
    )
    repeats = (
        here.filter(F.col("cursor_out").isNotNull())
        .groupBy("bundle", "cursor_out")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bundle")
        .agg(F.count_if(F.col("n") > 1).alias("repeated_cursors"))
    )
    ok = (
        (F.col("first_page") == 1)
        & (F.col("last_page") == F.col("pages"))
        & (F.col("gaps") + F.col("after_terminal") + F.col("broken_links") + F.col("repeated_cursors") == 0)
    )
    return (
        counted.join(repeats, "bundle", "left")
        .withColumn("repeated_cursors", F.coalesce("repeated_cursors", F.lit(0)))
        .withColumn("valid", ok)
    )


def page_provenance(index: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Page index rows with wrong request URL, size, digest or a URL with credentials.

    ``index`` carries ``expected_url`` (see sources.bundles.expected_request_urls).
    """
    a = artifacts.select("path", F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    url = F.coalesce(F.col("request_url"), F.lit(""))
    response = F.coalesce(F.col("effective_response_url"), F.lit(""))
    problem = (
        F.when(F.contains(url, F.lit("@")) | F.contains(response, F.lit("@")), "credentials in URL")
        .when(url != F.col("expected_url"), "request URL mismatch")
        .when(F.col("actual_sha256").isNull(), "missing page")
        .when(F.col("actual_size") != F.col("response_bytes"), "size mismatch")
        .when(F.col("actual_sha256") != F.col("sha256"), "digest mismatch")
    )
    return index.join(a, "path", "left").withColumn("problem", problem).filter(F.col("problem").isNotNull())


def snapshot_digest(artifacts: DataFrame) -> DataFrame:
    """Digest of the canonical file; of the list of part digests when it is a folder of parts.

    The part digests pass one task in order; neither they nor file contents are gathered.
    """
    parts = artifacts.filter(F.startswith("path", F.lit("canonical/servers.jsonl")))
    listed = ordered_digest(parts, "path", "sha256")
    single = parts.filter(F.col("path") == "canonical/servers.jsonl").agg(F.max("sha256").alias("d")).scalar()
    return listed.select(F.when(F.col("first") == "canonical/servers.jsonl", single).otherwise(F.col("digest")).alias("digest"))


def bundle_totals(manifest: DataFrame, records: DataFrame, index: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: whether counts and the snapshot digest agree with the manifest."""
    m = manifest.select(
        "snapshot_sha256",
        F.col("counts.pages").alias("pages"),
        F.col("counts.records_received").alias("received"),
        F.col("counts.unique_server_versions").alias("unique_versions"),
    )
    n_records = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_pages = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_received = index.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).scalar()
    digest = snapshot_digest(artifacts).scalar()
    return m.select(
        (n_records == F.col("unique_versions")).alias("records_ok"),
        (n_pages == F.col("pages")).alias("pages_ok"),
        (n_received == F.col("received")).alias("received_ok"),
        F.coalesce(digest == F.col("snapshot_sha256"), F.lit(False)).alias("digest_ok"),
    )


def rule_metadata_conflicts(findings: DataFrame, keys: list[str], metadata: list[str]) -> DataFrame:
    """Rules that occur with more than one metadata tuple inside a ruleset."""
    return (
        findings.groupBy(*keys)
        .agg(F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in metadata])).alias("variants"))
        .filter("variants > 1")
    )


def store_check(snapshots: DataFrame, tables: dict[str, DataFrame], expected_digest: str | None) -> DataFrame:
    """Row counts per table, and whether the newest snapshot has the expected digest."""
    newest = snapshots.orderBy(F.desc("completed_at"), F.desc("id")).limit(1)
    digest = newest.select("snapshot_sha256").scalar()
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out.select(
        "table_name",
        "row_count",
        digest.alias("latest_digest"),
        F.coalesce(digest == F.lit(expected_digest).cast("string"), F.lit(expected_digest is None)).alias("digest_ok"),
    )

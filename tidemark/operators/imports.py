"""Snapshot import: validate a bundle, keep new versions and their children, link everything.

Each import adds one folder of Parquet tables below the catalog root and becomes visible with its
marker file. Nothing stored is rewritten, a known snapshot is a no-op, and a failed attempt leaves
no visible rows.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS
from ..session import staged
from ..sinks.publish import _path, catalog_tables, generations, publish_generation, version_id
from ..sources import bundles
from . import explore, textindex, validation
from .snapshots import current_state, import_statistics, refresh_baseline, split_incoming


class InvalidBundle(ValueError):
    pass


def _imports(spark: SparkSession, root: str) -> list[str]:
    return generations(spark, root, "import-*")


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All visible tables of a catalog; an empty dict when nothing was imported."""
    folders = _imports(spark, root)
    return {name: spark.read.parquet(*[f"{f}/{name}" for f in folders]) for name in KEYS} if folders else {}


def baseline(spark: SparkSession, root: str) -> Row:
    """(base_snapshot_sha256, updated_since) that the next incremental collection starts from: the newest snapshot's."""
    stored = read_catalog(spark, root)
    found = refresh_baseline(stored["snapshots"]).first() if stored else None
    if found is None:
        raise InvalidBundle("catalog has no snapshot to start from")
    return found


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions that full and incremental snapshots together have as the newest of each (identifier, version)."""
    t = read_catalog(spark, root)
    newest = current_state(t["snapshot_server_versions"], t["snapshots"], t["server_versions"])
    return t["server_versions"].join(newest.select("id", "snapshot_id"), "id")


def _check_base(spark: SparkSession, manifest: DataFrame, stored: dict[str, DataFrame]) -> None:
    """An incremental bundle must name a snapshot that the catalog has, and reach back to it."""
    head = manifest.select("collection_mode", "updated_since", "base_snapshot_sha256").first()
    if (head.collection_mode or "full") == "full":
        return
    if not head.updated_since or not head.base_snapshot_sha256:
        raise InvalidBundle("incremental bundle without its base")
    known = stored["snapshots"].filter(F.col("snapshot_sha256") == head.base_snapshot_sha256).select("completed_at").first() if stored else None
    if known is None:
        raise InvalidBundle(f"base snapshot {head.base_snapshot_sha256} is not in the catalog")
    if head.updated_since > known.completed_at:
        raise InvalidBundle(f"changes between {known.completed_at} and {head.updated_since} are in no snapshot")


def claim_number(spark: SparkSession, root: str, digest: str, first: int = 1) -> int:
    """A snapshot number that no other import has, from ``first`` on.

    A claim is a file that only one job can create. An import that broke off finds its own claim again if no later number
    is taken yet.
    """
    number = first
    while True:
        path, fs = _path(spark, f"{root}/_claims/{number:08d}")
        try:
            out = fs.create(path, False)
            out.write(digest.encode())
            out.close()
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName() and not fs.exists(path):
                raise
        held = spark.read.text(path.toString()).first()
        if held is not None and held[0] == digest:
            return number
        number += 1


def not_imported(spark: SparkSession, found: list[str], root: str) -> list[str]:
    """Of some bundles those whose snapshot the catalog lacks, one for each digest, in name order: one anti-join."""
    if not found:
        return []
    digests = bundles.read_manifest(spark, found).groupBy("snapshot_sha256").agg(F.min("bundle").alias("bundle"))
    folders = _imports(spark, root)
    if folders:
        known = spark.read.parquet(*[f"{f}/snapshots" for f in folders]).select("snapshot_sha256")
        digests = digests.join(known, "snapshot_sha256", "left_anti")
    return sorted(r.bundle for r in digests.select("bundle").collect())  # of one batch


def read_index(spark: SparkSession, root: str) -> textindex.TextIndex:
    """The full-text index of a catalog: one segment for each import, over the versions it added."""
    return textindex.TextIndex.read(spark, root, "import-*", "search_")


def check_bundle(spark: SparkSession, bundle: str) -> DataFrame:
    """All problems of a bundle as ``(check, detail)`` rows; empty for a valid bundle."""
    manifest = bundles.read_manifest(spark, bundle)
    artifacts = staged(bundles.read_artifacts(spark, bundle), "artifacts")
    records = staged(bundles.read_canonical(spark, bundle, numbered=True), "records")
    index = bundles.read_page_index(spark, bundle)
    head = manifest.select("registry_base_url", "updated_since").limit(1).collect()[0]
    declared = manifest.select(F.explode("artifacts").alias("a")).select("a.*")
    parts = [
        validation.artifact_mismatches(declared, artifacts).select(F.lit("artifact").alias("check"), F.concat_ws(": ", "path", "problem").alias("detail")),
        validation.record_problems(records).select(F.lit("record"), "problem"),
        validation.order_breaks(
            records.select("line_no", "seq.file", "record.server_identifier", "record.server_version"),
            "file",
            "line_no",
            ["server_identifier", "server_version"],
        ).select(F.lit("order"), F.concat_ws("@", "server_identifier", "server_version")),
        validation.duplicate_identities(
            records.select("record.server_identifier", "record.server_version"), ["server_identifier", "server_version"]
        ).select(F.lit("duplicate"), F.concat_ws("@", "server_identifier", "server_version")),
        validation.page_provenance(
            bundles.expected_request_urls(index, head["registry_base_url"], head["updated_since"]), artifacts
        ).select(F.lit("page"), F.concat_ws(": ", "path", "problem")),
    ]
    chain = validation.page_chain(
        index.withColumn("bundle", F.lit(bundle)), "bundle", "page_number", "pagination_input", "pagination_output"
    )
    parts.append(chain.filter("NOT valid").select(F.lit("chain"), F.to_json(F.struct("*"))))
    totals = validation.bundle_totals(manifest, records, index, artifacts)
    parts.append(
        totals.filter(~(F.col("records_ok") & F.col("pages_ok") & F.col("received_ok") & F.col("digest_ok"))).select(
            F.lit("totals"), F.to_json(F.struct("*"))
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def import_bundle(spark: SparkSession, bundle: str, root: str, imported_at: str, check: bool = True) -> dict | None:
    """Import one completed bundle; statistics of the import, or None when it is known already."""
    if not bundles.is_completed(spark, bundle):
        raise InvalidBundle("bundle has no completion marker")
    manifest = bundles.read_manifest(spark, bundle)
    digest = manifest.select("snapshot_sha256").limit(1).collect()[0][0]
    folders = _imports(spark, root)
    if any(f.endswith(f"-{digest}") for f in folders):
        return None
    if check:
        problems = staged(check_bundle(spark, bundle), "problems")
        count = problems.count()
        if count:
            raise InvalidBundle(f"{count} problems, all in {problems.inputFiles()[0].rsplit('/', 1)[0]}")
    stored = read_catalog(spark, root)
    _check_base(spark, manifest, stored)
    number = claim_number(spark, root, digest, len(folders) + 1)
    # Parsed once; every table below reads only its own columns of the staged records.
    records = staged(bundles.read_canonical(spark, bundle), "records")
    tables = catalog_tables(records)
    versions = tables.pop("server_versions")
    keys = ["server_identifier", "server_version", "canonical_sha256"]
    existing = stored["server_versions"] if stored else versions.limit(0)
    outcomes = staged(split_incoming(versions, existing), "outcomes")  # six tables and the statistics follow from it
    added = versions.join(outcomes.filter("outcome <> 'reused'").select(*keys), keys, "left_semi").select(versions.columns)
    new_ids = added.select(F.col("id").alias("server_version_id"))
    kept = {}
    for name in ("repositories", "packages", "remotes"):
        kept[name] = tables[name].join(new_ids, "server_version_id", "left_semi").select(tables[name].columns)
    new_packages = kept["packages"].select(F.col("id").alias("package_id"))
    for name in ("package_arguments", "package_environment"):
        kept[name] = tables[name].join(new_packages, "package_id", "left_semi").select(tables[name].columns)
    snapshot = manifest.select(
        F.lit(number).cast("bigint").alias("id"),
        "snapshot_sha256",
        "completed_at",
        "started_at",
        "registry_base_url",
        F.col("collector.name").alias("collector_name"),
        F.col("collector.version").alias("collector_version"),
        F.col("collector.git_commit").alias("collector_git_commit"),
        "bundle_version",
        F.lit(bundle).alias("source_bundle_path"),
        F.col("counts.pages").alias("pages"),
        F.col("counts.records_received").alias("records_received"),
        F.col("counts.unique_server_versions").alias("unique_server_versions"),
        F.lit(imported_at).alias("imported_at"),
        F.coalesce("collection_mode", F.lit("full")).alias("collection_mode"),
        "updated_since",
        "base_snapshot_sha256",
    )
    links = versions.select(F.lit(number).cast("bigint").alias("snapshot_id"), F.col("id").alias("server_version_id"))
    texts = explore.search_documents(records).select(
        "record.server_identifier", "record.server_version", "record.canonical_sha256", "record.description", *explore.SEARCH_FIELDS[2:]
    )
    texts = texts.withColumn("server_version_id", version_id()).join(new_ids, "server_version_id", "left_semi")
    segment = textindex.segment(texts, "server_version_id", explore.SEARCH_FIELDS)
    statistics = import_statistics(outcomes).collect()[0].asDict()
    folder = publish_generation(
        {"snapshots": snapshot, "server_versions": added, "snapshot_server_versions": links, **kept, **{f"search_{n}": df for n, df in segment.items()}},
        root,
        f"import-{number:08d}-{digest}",
        {f"search_{n}": column for n, column in textindex.FOLDERED.items()},
    )
    # counts of what was written come from the files' footers
    for name in ("repositories", "packages", "remotes"):
        statistics[name] = spark.read.parquet(f"{folder}/{name}").count()
    statistics["links"] = spark.read.parquet(f"{folder}/snapshot_server_versions").count()
    return statistics

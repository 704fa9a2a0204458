"""Snapshot bundles: raw pages, page index, manifest, canonical records, completed folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, documents, urls
from ..schemas import CANONICAL_RECORD, MANIFEST, OFFICIAL_META, PAGE, PAGE_INDEX
from ..session import dealt
from .files import file_digests
from .lines import number_lines, read_lines

# Fixed values.
REGISTRY_NAME = "official-mcp"
CORRUPT = "_rejected"
# End of fixed values.


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def completed_bundles(spark: SparkSession, root: str) -> list[str]:
    """Folders below ``root`` whose marker file exists; the marker is written last."""
    target, fs = _files(spark, f"{root}/*/_SUCCESS")
    found = fs.globStatus(target)
    return sorted(str(s.getPath().getParent().toString()) for s in (found or []))


def is_completed(spark: SparkSession, bundle: str) -> bool:
    target, fs = _files(spark, f"{bundle}/_SUCCESS")
    return bool(fs.exists(target))


def read_manifest(spark: SparkSession, bundles: str | list[str]) -> DataFrame:
    paths = [f"{b}/manifest.json" for b in ([bundles] if isinstance(bundles, str) else bundles)]
    return (
        spark.read.schema(MANIFEST)
        .json(paths, multiLine=True)
        .select("*", F.regexp_replace(F.col("_metadata.file_path"), r"/manifest\.json.*\z", "").alias("bundle"))
    )


def read_page_index(spark: SparkSession, bundle: str) -> DataFrame:
    return spark.read.schema(PAGE_INDEX).json(f"{bundle}/raw/pages.jsonl")


def read_pages(spark: SparkSession, bundle: str) -> DataFrame:
    """One row per raw page: number, body, cursors and the entry texts.

    A page is one bounded response (8 MiB at most), so a whole file per row is safe.
    """
    # one listing of the folder instead of one for each page
    whole = spark.read.option("recursiveFileLookup", "true").text(f"{bundle}/raw", wholetext=True)
    raw = whole.where(F.col("_metadata.file_path").rlike(r"/raw/page[-=][^/]*(?:/[^/]*)?\z")).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/raw/page[-=]0*([0-9]+)", 1).cast("bigint").alias("page"),
        F.col("value").alias("body"),
    )
    doc = raw.withColumn("doc", F.from_json("body", PAGE))
    return doc.select(
        "page",
        "body",
        F.col("doc.metadata.cursor").alias("declared_cursor"),
        F.nullif(F.col("doc.metadata.nextCursor"), F.lit("")).alias("next_cursor"),
        documents.item_list("servers")("body").alias("servers"),
    )


def page_entries(pages: DataFrame) -> DataFrame:
    """Flatten ``servers[]`` to one raw entry per row, in page order."""
    return pages.select("page", F.posexplode("servers").alias("position", "entry"))


def build_records(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Canonical record of each raw entry, with identity, digest and stable time, or ``error``."""
    build = documents.record_builder(REGISTRY_NAME, OFFICIAL_META)
    return dealt(entries).withColumn("_r", build(F.col(entry))).select(*entries.columns, "_r.*")


def updated_entries(entries: DataFrame, since: str, entry: str = "entry") -> DataFrame:
    """Raw entries that an incremental collection asks for: updated at ``since`` or later; times compare as text.

    The bound itself belongs to them, so what changed at the very time of the base comes again and is folded by the import.
    """
    official = F.from_json(entry, f"_meta struct<`{OFFICIAL_META}`: struct<updatedAt: string>>")["_meta"][OFFICIAL_META]
    return entries.filter(official["updatedAt"] >= since)


def unique_records(records: DataFrame) -> DataFrame:
    """Byte-identical duplicates collapsed; equal identity with other bytes fails the job."""
    bad = F.concat_ws("@", F.lit("conflicting duplicate records"), "server_identifier", "server_version")
    return (
        records.groupBy("server_identifier", "server_version")
        .agg(
            F.min("canonical_json").alias("canonical_json"),
            # digests instead of the texts: one text of a record is shuffled, not two
            F.min(F.sha2("canonical_json", 256)).alias("_first"),
            F.max(F.sha2("canonical_json", 256)).alias("_last"),
            F.min("canonical_sha256").alias("canonical_sha256"),
            F.min("observed_at").alias("observed_at"),
        )
        .filter(
            F.when(F.col("_first") != F.col("_last"), F.raise_error(bad)).otherwise(F.lit(True))
        )
        .drop("_first", "_last")
    )


def read_canonical(spark: SparkSession, bundle: str, numbered: bool = False) -> DataFrame:
    """Canonical records: source line kept as ``canonical_json``, parsed form in ``record``.

    ``error`` says why a line is not acceptable (an empty line is one of the reasons).
    """
    lines = read_lines(spark, f"{bundle}/canonical/servers.jsonl")
    if numbered:
        lines = number_lines(lines)
    return parse_canonical(lines)


def parse_canonical(lines: DataFrame) -> DataFrame:
    # A member of another type lands in the reject column instead of being read as absent.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    schema = f"{CANONICAL_RECORD}, {CORRUPT} string"
    out = lines.withColumn("record", F.from_json("value", schema, options))
    r = F.col("record")
    packages_ok = F.forall(
        F.coalesce(r["packages"], F.array()),
        lambda p: (F.coalesce(p["registryType"], F.lit("")) != "")
        & (F.coalesce(p["identifier"], F.lit("")) != "")
        & (F.coalesce(p["transport"]["type"], F.lit("")) != ""),
    )
    remotes_ok = F.forall(
        F.coalesce(r["remotes"], F.array()),
        lambda p: (F.coalesce(p["url"], F.lit("")) != "") & (F.coalesce(p["type"], F.lit("")) != ""),
    )
    identity_ok = (
        checks.valid_server_name(r["server_identifier"])
        & checks.valid_server_version(r["server_version"])
        & (r["canonical_sha256"] != "")
    )
    error = (
        F.when(F.col("value") == "", "canonical record is empty")
        .when(r.isNull() | r[CORRUPT].isNotNull(), "canonical record must be an object")
        .when(~F.coalesce(identity_ok, F.lit(False)), "invalid canonical identity")
        .when(~packages_ok, "invalid package declaration")
        .when(~remotes_ok, "invalid remote declaration")
    )
    keep = [c for c in ("seq", "line_no") if c in lines.columns]
    return out.select(*keep, F.col("value").alias("canonical_json"), "record", error.alias("error"))


def record_digest(canonical: Column | str) -> Column:
    """Digest of a canonical record without its time and digest members."""
    c = F.col(canonical) if isinstance(canonical, str) else canonical
    body = F.regexp_replace(c, r'\A\{"canonical_sha256":"[0-9a-f]{64}",', "{")
    # Only a description can stand before the time member, and text inside it has its quotes
    # escaped, so the first literal match is the member itself.
    at = F.position(F.lit('"observed_at":"'), body)
    tail = F.substring(body, at, F.lit(2**31 - 1))
    rest = F.regexp_replace(tail, r'\A"observed_at":"[^"\\]*",?', "")
    return F.sha2(F.concat(F.substring(body, F.lit(1), at - 1), rest), 256)


def read_artifacts(spark: SparkSession, bundle: str) -> DataFrame:
    """Path, size and digest of every page and canonical file of a bundle.

    A page is a file or a folder with one file, which goes by the name of its folder.
    """
    relative = F.regexp_extract("path", r"/((?:raw|canonical)/.*)\z", 1)
    name = F.regexp_replace(relative, r"\A(raw/page=[0-9]+)/.*\z", "$1")
    # a folder without canonical records has no such path
    return file_digests(spark, f"{bundle}/{{raw,canonical}}", only=r"/(?:raw/page[-=]|canonical/)").withColumn("path", name)


def expected_request_urls(index: DataFrame, base: str, updated_since: str | None) -> DataFrame:
    """Page index rows with the URL each page must have been requested from."""
    return index.withColumn(
        "expected_url",
        urls.api_url(F.lit(base), F.col("pagination_input"), F.lit(updated_since).cast("string")),
    )

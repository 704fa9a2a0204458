"""Snapshot bundles written from the tables, then read, checked and imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import explore, imports, validation
from ..schemas import OFFICIAL_META
from ..session import scratch, staged
from ..sinks.publish import catalog_tables, write_canonical
from ..sources import bundles
from .bundle_fixture import write_bundle, write_pages
from .views import query, table

PAGE_SIZE = 30
BASE = "https://registry.example"


def _entry(description: Column, updated: Column | None = None) -> Column:
    """Raw registry entry of a part. Part keys are unique, so identities are too."""
    updated = F.lit("2024-01-01T00:00:00Z") if updated is None else updated
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    package = F.concat(
        F.lit('"packages":[{"registryType":"'), F.when(F.col("p_size") % 2 == 0, "npm").otherwise("pypi"), F.lit('","identifier":"pkg-'), key,
        F.lit('","version":"1.'), size, F.lit('","transport":{"type":"stdio"},"packageArguments":[{"type":"positional","value":"serve"},{"type":"x"}],'),
        F.lit('"environmentVariables":[{"name":"TOKEN","isRequired":true}]}],'),
    )
    remote = F.concat(F.lit('"remotes":[{"type":"sse","url":"https://H'), size, F.lit('.example:8443/sse"}],'))
    return F.concat(
        F.lit('{"server":{"name":"io.example/part-'), key, F.lit('","version":"'), size, F.lit('.0","description":"'), description, F.lit('",'),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(package), F.when(F.col("p_size") % 5 == 0, remote).otherwise(""),
        F.lit('"repository":{"source":"github","url":"https://github.com/o/'), key, F.lit('.git"}, "weight": 1.50},'),
        F.lit(f'"_meta":{{"{OFFICIAL_META}":{{"status":"active","updatedAt":"'), updated, F.lit('"}}}'),
    )


def _entries(spark: SparkSession, sf: str, description: Column | None = None) -> DataFrame:
    page = F.floor(F.col("p_partkey") / PAGE_SIZE) + 1
    made = _entry(F.col("p_type") if description is None else description)
    return table(spark, sf, "part").select(page.alias("page"), F.col("p_partkey").alias("position"), made.alias("entry"))


_ENTRY_CANON = f"""'{{"_meta":{{"{OFFICIAL_META}":{{"status":"active","updatedAt":"2024-01-01T00:00:00Z"}}}},"server":' ||
'{{"description":"' || p_type || '","name":"io.example/part-' || p_partkey || '",' || pk || rm || rp || ',"version":"' || p_size || '.0","weight":1.50}}}}'"""
_CANON = f"""WITH e AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE '"packages":[{{"environmentVariables":[{{"isRequired":true,"name":"TOKEN"}}],"identifier":"pkg-' || p_partkey ||
'","packageArguments":[{{"type":"positional","value":"serve"}},{{"type":"x"}}],"registryType":"' || CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'pypi' END ||
'","transport":{{"type":"stdio"}},"version":"1.' || p_size || '"}}],' END AS pk,
CASE WHEN p_size % 5 = 0 THEN '"remotes":[{{"type":"sse","url":"https://H' || p_size || '.example:8443/sse"}}],' ELSE '' END AS rm,
'"repository":{{"source":"github","url":"https://github.com/o/' || p_partkey || '.git"}}' AS rp FROM part),
l AS (SELECT *, '{{"description":"' || p_type || '","original":' || {_ENTRY_CANON} || ',' || pk || '"record_version":1,"registry":"official-mcp",' || rm || rp ||
  ',"server_identifier":"io.example/part-' || p_partkey || '","server_version":"' || p_size || '.0"}}' AS logical FROM e)"""


@query(
    "s5_raw_pages",
    f"""{_CANON} SELECT p_partkey // {PAGE_SIZE} + 1 AS page, p_partkey % {PAGE_SIZE} AS position, 'io.example/part-' || p_partkey AS server_identifier,
    p_size || '.0' AS server_version, sha256(logical) AS canonical_sha256, CAST(NULL AS VARCHAR) AS error FROM l""",
)
def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "pages")
    write_pages(_entries(spark, sf), root)
    records = bundles.build_records(bundles.page_entries(bundles.read_pages(spark, root)))
    return records.select(
        "page", F.col("position").cast("bigint").alias("position"), "server_identifier", "server_version", "canonical_sha256", "error"
    )


@query(
    "f11_canonical_records",
    f"""{_CANON} SELECT 'io.example/part-' || p_partkey AS server_identifier, sha256(logical) AS canonical_sha256, '2024-01-01T00:00:00Z' AS observed_at,
    '{{"canonical_sha256":"' || sha256(logical) || '",' || replace(substr(logical, 2), '","original":', '","observed_at":"2024-01-01T00:00:00Z","original":') AS canonical_json FROM l""",
)
def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    records = bundles.build_records(_entries(spark, sf))
    return records.select("server_identifier", "canonical_sha256", "observed_at", "canonical_json")


@query(
    "k2_s4_v9_canonical_scan",
    f"{_CANON} SELECT 'io.example/part-' || p_partkey AS server_identifier, p_size || '.0' AS server_version, sha256(logical) AS canonical_sha256, TRUE AS digest_ok FROM l",
)
def canonical_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "canonical")
    write_canonical(bundles.unique_records(bundles.build_records(_entries(spark, sf))), f"{root}/canonical/servers.jsonl")
    rows = bundles.read_canonical(spark, root)
    return rows.filter("error IS NULL").select(
        "record.server_identifier",
        "record.server_version",
        "record.canonical_sha256",
        (bundles.record_digest("canonical_json") == F.col("record.canonical_sha256")).alias("digest_ok"),
    )


@query(
    "v9_record_problems",
    """SELECT p_partkey AS line_no, CASE p_partkey % 7 WHEN 0 THEN 'canonical record digest mismatch' WHEN 1 THEN 'canonical record is not canonical JSON'
    WHEN 2 THEN 'canonical record is empty' WHEN 3 THEN 'canonical record must be an object' ELSE 'invalid package declaration' END AS problem
    FROM part WHERE p_partkey % 7 < 4 OR (p_partkey % 7 = 4 AND p_size % 3 <> 0)""",
)
def record_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical lines of which some are spoiled: another version, a blank in front, nothing, an array, a package without a name."""
    kind, line = F.col("position") % 7, F.col("canonical_json")
    spoiled = (
        F.when(kind == 0, F.replace(line, F.lit('"server_version":"'), F.lit('"server_version":"9')))
        .when(kind == 1, F.concat(F.lit(" "), line))
        .when(kind == 2, "")
        .when(kind == 3, "[1]")
        .when(kind == 4, F.replace(line, F.concat(F.lit('"identifier":"pkg-'), F.col("position").cast("string")), F.lit('"identifier":"')))
        .otherwise(line)
    )
    lines = bundles.build_records(_entries(spark, sf)).select(F.col("position").alias("line_no"), spoiled.alias("value"))
    return validation.record_problems(bundles.parse_canonical(lines)).select("line_no", "problem")


def _child_sql(kind: str) -> str:
    return {
        "repositories": "SELECT 'repositories' AS kind, 'io.example/part-' || p_partkey AS owner, 0 AS position, 'github.com/o/' || p_partkey AS value FROM part",
        "packages": "SELECT 'packages', 'io.example/part-' || p_partkey, 0, 'pkg-' || p_partkey FROM part WHERE p_size % 3 <> 0",
        "arguments": "SELECT 'arguments', 'io.example/part-' || p_partkey, a, CASE a WHEN 0 THEN 'serve' END FROM part, range(0, 2) t(a) WHERE p_size % 3 <> 0",
        "environment": "SELECT 'environment', 'io.example/part-' || p_partkey, 0, 'TOKEN' FROM part WHERE p_size % 3 <> 0",
        "remotes": "SELECT 'remotes', 'io.example/part-' || p_partkey, 0, 'h' || p_size || '.example:8443' FROM part WHERE p_size % 5 = 0",
    }[kind]


@query(
    "k3_catalog_tables",
    " UNION ALL ".join(_child_sql(k) for k in ("repositories", "packages", "arguments", "environment", "remotes")),
)
def normalized_tables(spark: SparkSession, sf: str) -> DataFrame:
    parsed = bundles.parse_canonical(bundles.build_records(_entries(spark, sf)).select(F.col("canonical_json").alias("value")))
    t = catalog_tables(staged(parsed, "records"))
    owner = t["server_versions"].select(F.col("id").alias("server_version_id"), F.col("server_identifier").alias("owner"))
    by_package = t["packages"].select(F.col("id").alias("package_id"), "server_version_id")
    parts = [
        t["repositories"].select("server_version_id", F.lit("repositories").alias("kind"), F.lit(0).alias("position"), F.concat_ws("/", "host", "owner", "repository_name").alias("value")),
        t["packages"].select("server_version_id", F.lit("packages"), "position", "identifier"),
        t["package_arguments"].join(by_package, "package_id").select("server_version_id", F.lit("arguments"), "position", "argument_value"),
        t["package_environment"].join(by_package, "package_id").select("server_version_id", F.lit("environment"), "position", "name"),
        t["remotes"].select("server_version_id", F.lit("remotes"), "position", F.concat_ws(":", "host", "port")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.join(owner, "server_version_id").select("kind", "owner", F.col("position").cast("bigint").alias("position"), "value")


@query(
    "f14_search_documents",
    """SELECT 'io.example/part-' || p_partkey AS server_identifier, CASE WHEN p_size % 3 <> 0 THEN 'pkg-' || p_partkey ELSE '' END AS package_identifiers,
    'https://github.com/o/' || p_partkey || '.git' AS repository_url, CASE WHEN p_size % 5 = 0 THEN 'https://H' || p_size || '.example:8443/sse' ELSE '' END AS remote_urls,
    CASE WHEN p_size % 5 = 0 THEN 'h' || p_size || '.example' ELSE '' END AS remote_hosts FROM part""",
)
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    parsed = bundles.parse_canonical(bundles.build_records(_entries(spark, sf)).select(F.col("canonical_json").alias("value")))
    docs = explore.search_documents(parsed)
    return docs.select("record.server_identifier", "package_identifiers", "repository_url", "remote_urls", "remote_hosts")


@query(
    "t3_show_nested",
    """SELECT 'io.example/part-' || p_partkey AS server_identifier, p_type AS description, CASE WHEN p_size % 3 <> 0 THEN 2 ELSE 0 END AS arguments,
    CASE WHEN p_size % 5 = 0 THEN 'sse' END AS remote_type FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size % 15 = 10)""",
)
def show_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The record of one identifier; entries of others are left out before records are built."""
    newest = table(spark, sf, "part").filter("p_size % 15 = 10").agg(F.max("p_partkey").cast("string").alias("k")).scalar()
    named = F.get_json_object("entry", "$.server.name") == F.concat(F.lit("io.example/part-"), newest)
    mine = bundles.build_records(_entries(spark, sf).filter(named)).withColumn("id", F.col("canonical_sha256"))
    shown = explore.nested(mine)
    return shown.select(
        "server_identifier",
        "description",
        F.coalesce(F.size(F.col("packages")[0]["packageArguments"]), F.lit(0)).cast("bigint").alias("arguments"),
        F.col("remotes")[0]["type"].alias("remote_type"),
    )


def _bundle(spark: SparkSession, sf: str, folder: str, day: int, description: Column | None = None) -> str:
    return write_bundle(_entries(spark, sf, description), f"{folder}/b{day}", BASE, f"2024-01-{day:02d}T00:00:00Z")


@query(
    "s6_s7_s12_bundle_files",
    f"""SELECT page_number, records, CASE WHEN page_number = 1 THEN NULL ELSE 'c/' || (page_number - 1) END AS pagination_input,
    '{BASE}/v0.1/servers' || CASE WHEN page_number = 1 THEN '' ELSE '?cursor=c%2F' || (page_number - 1) END AS request_url,
    (SELECT count(*) FROM part) AS declared, 1 AS bundles FROM
    (SELECT p_partkey // {PAGE_SIZE} + 1 AS page_number, count(*) AS records FROM part GROUP BY 1)""",
)
def bundle_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "bundles")
    bundle = _bundle(spark, sf, folder, 1)
    found = bundles.completed_bundles(spark, folder)
    declared = bundles.read_manifest(spark, found).agg(F.max("counts.unique_server_versions").alias("n"))
    return bundles.read_page_index(spark, bundle).select(
        F.col("page_number").cast("bigint").alias("page_number"),
        "records",
        "pagination_input",
        "request_url",
        declared.scalar().alias("declared"),
        F.lit(len(found)).cast("bigint").alias("bundles"),
    )


@query("v8_v12_bundle_problems", "SELECT CAST(NULL AS VARCHAR) AS \"check\", CAST(NULL AS VARCHAR) AS detail FROM part WHERE FALSE")
def bundle_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Files, records, order, pages, chain and totals of a bundle written by this library."""
    return imports.check_bundle(spark, _bundle(spark, sf, scratch(spark, "bundles"), 1))


@query(
    "v8_artifact_mismatches",
    f"""SELECT 'raw/page=' || page AS path, CASE page % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'digest' END AS problem
    FROM (SELECT DISTINCT p_partkey // {PAGE_SIZE} + 1 AS page FROM part) WHERE page % 3 <> 2""",
)
def artifact_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "pages")
    write_pages(_entries(spark, sf), root)
    actual = bundles.read_artifacts(spark, root)
    kind = F.regexp_extract("path", "=([0-9]+)", 1).cast("int") % 3
    declared = actual.select(
        "path",
        F.when(kind == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(kind == 1, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return validation.artifact_mismatches(declared, actual).select("path", "problem")


@query(
    "i1_snapshot_import",
    """SELECT s AS snapshot_id, 'io.example/part-' || p_partkey AS server_identifier, p_type || CASE WHEN s = 2 AND p_size % 4 = 0 THEN ' new' ELSE '' END AS description,
    CASE WHEN p_size % 3 <> 0 THEN 1 ELSE 0 END AS packages FROM part, range(1, 3) t(s)""",
)
def snapshot_import(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots; the second changes some descriptions and is imported twice."""
    folder, root = scratch(spark, "bundles"), scratch(spark, "catalog")
    changed = F.when(F.col("p_size") % 4 == 0, F.concat("p_type", F.lit(" new"))).otherwise(F.col("p_type"))
    imports.import_bundle(spark, _bundle(spark, sf, folder, 1), root, "2024-02-01T00:00:00Z")
    second = _bundle(spark, sf, folder, 2, changed)
    imports.import_bundle(spark, second, root, "2024-02-02T00:00:00Z")
    imports.import_bundle(spark, second, root, "2024-02-03T00:00:00Z")
    t = imports.read_catalog(spark, root)
    counts = t["packages"].groupBy("server_version_id").agg(F.count(F.lit(1)).alias("packages"))
    rows = t["snapshot_server_versions"].join(t["server_versions"].withColumnRenamed("id", "server_version_id"), "server_version_id")
    return rows.join(counts, "server_version_id", "left").select(
        "snapshot_id", "server_identifier", "description", F.coalesce("packages", F.lit(0).cast("bigint")).alias("packages")
    )


_EDITED = [(2, "p_size % 4 = 0"), (3, "p_size % 6 = 0")]  # (day, parts that change on it)


def _edited_entries(spark: SparkSession, sf: str, day: int) -> DataFrame:
    """The registry as it is on a day: each edit adds to the description and sets the time."""
    description, updated = F.col("p_type"), F.lit("2024-01-01T00:00:00Z")
    for at, parts in _EDITED[: day - 1]:
        description = F.when(F.expr(parts), F.concat(description, F.lit(f" v{at}"))).otherwise(description)
        updated = F.when(F.expr(parts), F.lit(f"2024-01-{at:02d}T00:00:00Z")).otherwise(updated)
    page = F.floor(F.col("p_partkey") / PAGE_SIZE) + 1
    return table(spark, sf, "part").select(page.alias("page"), F.col("p_partkey").alias("position"), _entry(description, updated).alias("entry"))


@query(
    "i2_incremental_chain",
    """SELECT 'io.example/part-' || p_partkey AS server_identifier, p_type || CASE WHEN p_size % 4 = 0 THEN ' v2' ELSE '' END || CASE WHEN p_size % 6 = 0 THEN ' v3' ELSE '' END AS description,
    CASE WHEN p_size % 4 = 0 OR p_size % 6 = 0 THEN 3 ELSE 1 END AS snapshot_id FROM part""",
)
def incremental_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A full snapshot and two increments, each from the base before it; what changed at the time of the base comes twice."""
    folder, root = scratch(spark, "bundles"), scratch(spark, "catalog")
    imports.import_bundle(spark, write_bundle(_edited_entries(spark, sf, 1), f"{folder}/b1", BASE, "2024-01-01T12:00:00Z"), root, "2024-02-01T00:00:00Z", check=False)
    for day in (2, 3):
        base = imports.baseline(spark, root)
        changed = bundles.updated_entries(_edited_entries(spark, sf, day), base.updated_since)
        # a bundle is dense in its pages, whatever was left out
        numbers = changed.groupBy("page").agg(F.count(F.lit(1)).alias("n")).select("page", F.row_number().over(Window.orderBy("page")).cast("bigint").alias("dense"))
        dense = changed.join(numbers, "page").select(F.col("dense").alias("page"), "position", "entry")
        bundle = write_bundle(dense, f"{folder}/b{day}", BASE, f"2024-01-{day:02d}T00:00:00Z", base.updated_since, base.base_snapshot_sha256)
        imports.import_bundle(spark, bundle, root, f"2024-02-{day:02d}T00:00:00Z", check=False)
    return imports.current_versions(spark, root).select("server_identifier", "description", "snapshot_id")

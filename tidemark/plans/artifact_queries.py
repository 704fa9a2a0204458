"""Archive and rule-scan queries with their oracles."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import SEVERITIES
from ..operators import artifacts, detectors, summaries
from ..session import scratch, staged
from ..sinks.publish import export_details
from ..sources import archives
from ..sources.rules import RuleSet, default_document, default_rules, load_rules, parse_rules, rule_problems, rule_table
from . import views as v
from .scalar_queries import _EXT_SQL, _TYPES, document_path
from .views import query, table, with_views

# --- text rules: the same document layout, with web-page words -------------------------------

PAGE_BUILTINS = (("charset", ["utf-8"], "low"), ("ad", ["ad"], "medium"))
PAGE_RULES = (
    ("page:track", "call", "track", "medium", False),
    ("page:track-argument", "nonliteral_require", "track", "high", False),
    ("page:ad-comment", "substring", "<!-- ad", "low", False),
    ("page:new-thing", "websocket_call", "track", "info", True),
    ("page:owner-call", "process_call", "track", "high", False),
    ("page:footer", "substring", "<footer>", "info", True),
    ("page:only-plain", "substring", "the", "info", True),
)
PAGE_MARKERS = ("subscribe", "***")


@lru_cache(maxsize=1)
def page_rules() -> RuleSet:
    doc = default_document()
    doc["engine_options"] = {"process_call_owners": ["window", "doc"], "documentation_context_markers": list(PAGE_MARKERS)}
    doc["node_builtin_rules"] = [{"symbol": s, "tokens": t, "severity": sev} for s, t, sev in PAGE_BUILTINS]
    doc["risk_api_rules"] = [
        {"rule_id": i, "detector": d, "pattern": p, "symbol": p, "severity": s, "title": i, "suppress_documentation_context": x}
        for i, d, p, s, x in PAGE_RULES
    ]
    return parse_rules(doc)


_W = "[^A-Za-z0-9_$]"
_CALL = f"regexp_matches(line, '(^|{_W})track\\(')"
_SUPPRESSED = "(contains(lower(line), 'subscribe') OR contains(line, '***'))"
_CONDITIONS = {
    "node-builtin:charset": "contains(line, '\"utf-8\"') OR contains(line, '''utf-8''')",
    "node-builtin:ad": "contains(line, '\"ad\"') OR contains(line, '''ad''')",
    "page:track": _CALL,
    "page:track-argument": f"regexp_matches(line, '(^|{_W})track\\s*\\(\\s*[^\\s''\"]')",
    "page:ad-comment": "contains(line, '<!-- ad')",
    "page:new-thing": f"contains(line, 'new track') OR {_CALL}",
    "page:owner-call": f"regexp_matches(line, '(^|[^A-Za-z0-9_$.])track\\(|(^|{_W})(?i:window|doc)\\.track\\(')",
    "page:footer": f"contains(line, '<footer>') AND NOT {_SUPPRESSED}",
    "page:only-plain": f"contains(line, 'the') AND NOT {_SUPPRESSED}",
}
_LINES = """SELECT 'page' AS kind, page_id AS id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_number FROM pages
UNION ALL SELECT 'doc', doc_id, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM documents"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return pages.unionByName(docs)


@query(
    "b3_numbered_lines",
    f"WITH l AS ({_LINES}) SELECT kind, id, CAST(line_number AS BIGINT) AS line_number, sha256(line) AS digest FROM l",
)
def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = detectors.numbered_lines(_texts(spark, sf), "text", ["kind", "id"])
    return rows.select("kind", "id", F.col("line_number").cast("bigint").alias("line_number"), F.sha2("line", 256).alias("digest"))


def _page_findings(spark: SparkSession, sf: str) -> DataFrame:
    lines = detectors.numbered_lines(_texts(spark, sf), "text", ["kind", "id"])
    return detectors.line_findings(lines, page_rules(), ["kind", "id"])


@query(
    "j14_b4_b10_line_findings",
    f"WITH l AS ({_LINES}) "
    + " UNION ALL ".join(
        f"SELECT kind, id, CAST(line_number AS BIGINT) AS line_number, '{i}' AS rule_id FROM l WHERE {c}" for i, c in _CONDITIONS.items()
    ),
)
def line_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _page_findings(spark, sf).select("kind", "id", F.col("line_number").cast("bigint").alias("line_number"), "rule_id")


_CALLS = """SELECT o_orderkey, CASE o_custkey % 10 WHEN 0 THEN 'cp.exec(' WHEN 1 THEN '/x/.exec(' WHEN 2 THEN 'child_process .exec(' WHEN 3 THEN 'CP.execSync('
WHEN 4 THEN 'myexec(' WHEN 5 THEN 'require( name )' WHEN 6 THEN 'require( "fs" )' WHEN 7 THEN 'x = new Function' WHEN 8 THEN 'import("./' ELSE 'fetch(''https://' END
|| o_orderpriority AS line FROM orders"""
_CALL_FORMS = (
    "cp.exec(", "/x/.exec(", "child_process .exec(", "CP.execSync(", "myexec(", "require( name )", 'require( "fs" )', "x = new Function",
    'import("./', "fetch('https://",
)


@query(
    "b5_b9_default_rules",
    f"""WITH c AS ({_CALLS}), p AS (SELECT o_orderkey, line, '(^|{_W})(?i:cp|child_process|childprocess|proc|process)\\.' AS own FROM c)
    SELECT o_orderkey, 'risk-api:exec' AS rule_id FROM p WHERE regexp_matches(line, '(^|[^A-Za-z0-9_$.])exec\\(|' || own || 'exec\\(')
    UNION ALL SELECT o_orderkey, 'risk-api:execSync' FROM p WHERE regexp_matches(line, '(^|[^A-Za-z0-9_$.])execSync\\(|' || own || 'execSync\\(')
    UNION ALL SELECT o_orderkey, 'risk-api:nonliteral-require' FROM p WHERE contains(line, 'require( name')
    UNION ALL SELECT o_orderkey, 'node-builtin:fs' FROM p WHERE contains(line, '"fs"')
    UNION ALL SELECT o_orderkey, 'risk-api:Function' FROM p WHERE contains(line, 'new Function')
    UNION ALL SELECT o_orderkey, 'risk-api:dynamic-import' FROM p WHERE regexp_matches(line, '(^|{_W})import\\(')
    UNION ALL SELECT o_orderkey, 'risk-api:fetch' FROM p WHERE regexp_matches(line, '(^|{_W})fetch\\(')""",
)
def default_rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    form = F.element_at(F.array(*[F.lit(x) for x in _CALL_FORMS]), (1 + F.col("o_custkey") % 10).cast("int"))
    lines = table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("line_number"), F.concat(form, "o_orderpriority").alias("line"))
    return detectors.line_findings(lines, default_rules(), ["o_orderkey"]).select("o_orderkey", "rule_id")


@query(
    "w10_unique_findings",
    f"WITH l AS ({_LINES}) "
    + "SELECT kind, rule_id, count(*) AS n, count(DISTINCT (id, line_number)) AS places FROM ("
    + " UNION ALL ".join(f"SELECT kind, id, line_number, '{i}' AS rule_id FROM l WHERE {c}" for i, c in _CONDITIONS.items())
    + ") GROUP BY 1, 2",
)
def unique_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _page_findings(spark, sf).groupBy("kind", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id", "line_number").alias("places")
    )


@query(
    "a16_severity_histogram",
    with_views(
        """SELECT analysis_run_id, count(*) FILTER (WHERE severity = 'info') AS info_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
        count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
        count(*) FILTER (WHERE severity = 'critical') AS critical_count FROM findings GROUP BY 1""",
        "findings",
    ),
)
def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.severity_histogram(v.findings(spark, sf), ["analysis_run_id"])


# --- archives packed from documents ----------------------------------------------------------

PER_ARCHIVE = 8
_FILES = f"""SELECT doc_id // {PER_ARCHIVE} AS bucket, 'package/' || source || '/doc' || CAST(doc_id AS VARCHAR) || {_EXT_SQL} AS path, text,
CASE WHEN doc_id % 4 = 0 THEN 493 ELSE 420 END AS mode, ({list(_TYPES)!r})[1 + CAST(doc_id % 16 AS INTEGER)] AS file_type, doc_id, source FROM documents"""


def _document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Eight documents per archive: groups are bounded by construction."""
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 16 == 14, F.concat(F.unhex(F.lit("7F454C46")), body)).otherwise(body)
    return table(spark, sf, "documents").select(
        F.concat(F.lit("pkg-"), F.floor(F.col("doc_id") / PER_ARCHIVE).cast("string")).alias("archive"),
        document_path().alias("path"),
        content.alias("content"),
        F.when(F.col("doc_id") % 4 == 0, 0o755).otherwise(0o644).alias("mode"),
    )


def _manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """A package.json per archive, with scripts and dependencies taken from the bucket number."""
    bucket = F.floor(F.col("doc_id") / PER_ARCHIVE)
    b = bucket.cast("string")
    manifest = F.concat(
        F.lit('{"name":"@scope/pkg-'), b, F.lit('","version":"1.'), b, F.lit('.0","license":'),
        F.when(bucket % 3 == 0, '{"type":"MIT"}').otherwise('"MIT"'),
        F.lit(',"repository":'), F.when(bucket % 2 == 0, '"git:x"').otherwise('{"url":"git:y"}'),
        F.lit(',"bin":'), F.when(bucket % 2 == 0, '"cli.js"').otherwise(F.concat(F.lit('{"pkg-'), b, F.lit('":"run.js","other":7}'))),
        F.lit(',"scripts":{"install":"node x","test":"t","prepare":5},"dependencies":{"left":"^'), b,
        F.lit('.0","bad":1},"devDependencies":{"tool":"*"},"engines":{"node":">=18"}}'),
    )
    return table(spark, sf, "documents").select(bucket.alias("bucket"), manifest.alias("m")).distinct().select(
        F.concat(F.lit("pkg-"), F.col("bucket").cast("string")).alias("archive"),
        F.lit("package/package.json").alias("path"),
        F.encode("m", "UTF-8").alias("content"),
        F.lit(0o644).alias("mode"),
    )


def _members(spark: SparkSession, sf: str, manifests: bool = False, faults: bool = False) -> DataFrame:
    """The members of the archives that the documents stand for, with the archive's name, straight from the table.

    With ``faults`` archives with b % 5 = 1 have no manifest, and those with b % 5 = 2 a broken one.
    """
    files = _document_files(spark, sf)
    if manifests:
        own = _manifest_files(spark, sf)
        bucket = F.substring("archive", 5, 20).cast("long")
        if faults:
            broken = F.when(bucket % 5 == 2, F.encode(F.lit("[1"), "UTF-8")).otherwise(F.col("content"))
            own = own.where(bucket % 5 != 1).withColumn("content", broken)
        files = files.unionByName(own)
    order = F.row_number().over(Window.partitionBy("archive").orderBy("path"))  # an archive has few members
    return files.select(
        "archive",
        F.sha2("archive", 256).alias("artifact_sha256"),
        (order - 1).alias("member_index"),
        "path",
        F.lit("0").alias("typeflag"),
        F.octet_length("content").cast("bigint").alias("size"),
        "mode",
        F.lit("").alias("linkname"),
        "content",
        F.lit(None).cast("string").alias("archive_error"),
    )


def _packed(files: DataFrame) -> DataFrame:
    """One tar.gz of two gzip members for each archive; the input of the unpacking query."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for row in group.sort_values("path").itertuples():
                info = tarfile.TarInfo(row.path)
                info.size = len(row.content)
                info.mode = row.mode
                tar.addfile(info, io.BytesIO(row.content))
        data = raw.getvalue()
        half = len(data) // 2
        return pd.DataFrame({"archive": [group["archive"].iloc[0]], "content": [gzip.compress(data[:half]) + gzip.compress(data[half:])]})

    return files.groupBy("archive").applyInPandas(pack, "archive string, content binary")


@query(
    "s8_archive_members",
    f"""WITH f AS ({_FILES}) SELECT 'pkg-' || CAST(bucket AS VARCHAR) AS archive, path, strlen(text) + CASE WHEN doc_id % 16 = 14 THEN 4 ELSE 0 END AS size,
    mode, CASE WHEN doc_id % 16 <> 14 THEN sha256(text) END AS sha256 FROM f""",
)
def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    packed = staged(_packed(_document_files(spark, sf)), "archives")
    names, members = packed.select("archive", F.sha2("content", 256).alias("artifact_sha256")), archives.archive_members(packed)
    magic = F.hex(F.substring("content", 1, 4)) == "7F454C46"
    return members.join(names, "artifact_sha256").select(
        "archive", "path", "size", "mode", F.when(~magic, F.sha2("content", 256)).alias("sha256")
    )


@query(
    "v24_v25_archive_verdicts",
    f"""WITH f AS ({_FILES}) SELECT 'pkg-' || CAST(bucket AS VARCHAR) AS archive, count(*) AS files,
    CAST(sum(strlen(text) + CASE WHEN doc_id % 16 = 14 THEN 4 ELSE 0 END) AS BIGINT) AS total_bytes,
    CASE WHEN bool_or(source = 'src1') THEN 'archive contains parent-traversal path entry'
      WHEN max(strlen(text) + CASE WHEN doc_id % 16 = 14 THEN 4 ELSE 0 END) > 60000 THEN 'archive entry exceeds individual file size limit' END AS rejected FROM f GROUP BY 1""",
)
def archive_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    names = members.select("archive", "artifact_sha256").distinct()
    spoiled = members.withColumn("path", F.replace("path", F.lit("/src1/"), F.lit("/../")))
    verdicts = artifacts.archive_verdicts(spoiled, max_file_bytes=60000)
    return verdicts.join(names, "artifact_sha256").select("archive", "files", "total_bytes", "rejected")


_NATIVE = "file_type IN ('elf', 'native_node_module', 'shared_library', 'wasm')"


@query(
    "b1_file_inventory",
    f"""WITH f AS ({_FILES}) SELECT 'pkg-' || CAST(bucket AS VARCHAR) AS archive, path AS archive_path, file_type, mode = 493 AS executable, {_NATIVE} AS native_binary,
    file_type = 'source_map' AS generated, file_type IN ('javascript', 'typescript') AND strlen(text) > 4096 AND length(text) - length(replace(text, chr(10), '')) < 3 AS minified FROM f""",
)
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    names = members.select("archive", "artifact_sha256").distinct()
    rows = artifacts.file_inventory(members, default_rules()).join(names, "artifact_sha256")
    return rows.select("archive", "archive_path", "file_type", "executable", "native_binary", "generated", "minified")


@query(
    "b2_j21_file_type_findings",
    f"""WITH f AS ({_FILES}) SELECT path AS subject_path, CASE WHEN {_NATIVE} THEN 'file-type:native' ELSE 'file-type:' || file_type END AS rule_id,
    CASE WHEN {_NATIVE} THEN 'high' ELSE 'medium' END AS severity, file_type AS evidence FROM f
    WHERE {_NATIVE} OR file_type IN ('shell_script', 'powershell_script', 'nested_archive')""",
)
def file_type_findings(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    rules = default_rules()
    found = artifacts.file_type_findings(artifacts.file_inventory(members, rules), rules)
    return found.select("subject_path", "rule_id", "severity", "evidence")


_B = "SELECT DISTINCT doc_id // 8 AS b FROM documents"


@query(
    "b11_b12_npm_manifests",
    f"""SELECT '@scope/pkg-' || b AS package_name, '1.' || b || '.0' AS package_version, CASE WHEN b % 3 <> 0 THEN 'MIT' END AS license,
    CASE WHEN b % 2 = 0 THEN 'git:x' ELSE 'git:y' END AS repository, '>=18' AS engines_node, 1 AS bins,
    CASE WHEN b % 2 = 0 THEN 'cli.js' ELSE 'run.js' END AS executable FROM ({_B})""",
)
def npm_manifests(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf, manifests=True)
    rows = artifacts.npm_manifests(artifacts.select_manifest(members, "npm"))
    return rows.select(
        "package_name", "package_version", "license", "repository", "engines_node", F.size("bin_entries").alias("bins"),
        artifacts.package_bin(F.col("bin_entries"), F.col("package_name")).alias("executable"),
    )


@query(
    "b13_j22_lifecycle_findings",
    f"""SELECT b.b AS bucket, 'lifecycle:install' AS rule_id, 'high' AS severity, 'install' AS symbol, 'node x' AS evidence FROM ({_B}) b""",
)
def lifecycle_findings(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf, manifests=True)
    names = members.select("archive", "artifact_sha256").distinct()
    manifests = artifacts.npm_manifests(artifacts.select_manifest(members, "npm"))
    found = artifacts.lifecycle_findings(manifests, default_rules()).join(names, "artifact_sha256")
    return found.select(
        F.regexp_extract("archive", "([0-9]+)$", 1).cast("bigint").alias("bucket"), "rule_id", "severity", "symbol", "evidence"
    )


@query(
    "b14_npm_dependencies",
    f"""SELECT b AS bucket, 'runtime' AS dependency_type, 'left' AS dependency_name, '^' || b || '.0' AS declared_version, FALSE AS development FROM ({_B})
    UNION ALL SELECT b, 'development', 'tool', '*', TRUE FROM ({_B})""",
)
def npm_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf, manifests=True)
    names = members.select("archive", "artifact_sha256").distinct()
    manifests = artifacts.npm_manifests(artifacts.select_manifest(members, "npm"))
    rows = artifacts.npm_dependencies(manifests).join(names, "artifact_sha256")
    return rows.select(
        F.regexp_extract("archive", "([0-9]+)$", 1).cast("bigint").alias("bucket"), "dependency_type", "dependency_name", "declared_version", "development"
    )


@query(
    "b17_a17_archive_summaries",
    f"""WITH f AS ({_FILES}) SELECT bucket, count(*) + 1 AS analyzed_file_count, 2 AS dependency_count, bool_or({_NATIVE}) AS has_native_code, 'install' AS lifecycle,
    2 + count(*) FILTER (WHERE {_NATIVE} OR file_type IN ('shell_script', 'powershell_script', 'nested_archive')) AS finding_count FROM f WHERE bucket % 5 NOT IN (1, 2) GROUP BY 1""",
)
def archive_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata, lifecycle, file-type and line findings of every archive, folded per archive."""
    members = _members(spark, sf, manifests=True, faults=True)
    names = members.select("archive", "artifact_sha256").distinct()
    rules = default_rules()
    members = staged(members.drop("archive"), "members")
    accepted = artifacts.safe_members(members, artifacts.archive_verdicts(members))
    accepted, manifests = artifacts.analyzed(accepted, "npm")
    rows = artifacts.archive_summaries(
        artifacts.file_inventory(accepted, rules), artifacts.all_findings(accepted, rules, "npm"), artifacts.npm_dependencies(manifests)
    ).join(names, "artifact_sha256")
    return rows.select(
        F.regexp_extract("archive", "([0-9]+)$", 1).cast("bigint").alias("bucket"),
        "analyzed_file_count", "dependency_count", "has_native_code", F.array_join("lifecycle_scripts", ",").alias("lifecycle"), "finding_count",
    )


def _pkg_info(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit("Metadata-Version: 2.1\nName: "), "c_name", F.lit("\nName: again\nVersion:\t1."), key,
        F.lit("\nLicense: \nLicense: "), "c_mktsegment", F.lit("\r\nProject-URL: home, https://x/"), key,
        F.lit("\nHome-page: later\nRequires-Dist: alpha (>="), key, F.lit(")\nRequires-Dist: beta; extra == 'x'\nno colon here\nRequires-Dist: [odd]\n"),
    )
    return table(spark, sf, "customer").select(key.alias("artifact_sha256"), F.lit("d/PKG-INFO").alias("manifest_path"), body.alias("manifest"))


@query(
    "b15_pkg_info",
    """SELECT CAST(c_custkey AS VARCHAR) AS artifact_sha256, c_name AS package_name, '1.' || c_custkey AS package_version, c_mktsegment AS license,
    'home, https://x/' || c_custkey AS repository, CAST(NULL AS VARCHAR) AS error FROM customer""",
)
def pkg_info(spark: SparkSession, sf: str) -> DataFrame:
    rows = artifacts.pypi_manifests(_pkg_info(spark, sf))
    return rows.select("artifact_sha256", "package_name", "package_version", "license", "repository", "error")


@query(
    "b15_pypi_dependencies",
    """SELECT CAST(c_custkey AS VARCHAR) AS artifact_sha256, 'alpha' AS dependency_name, 'alpha (>=' || c_custkey || ')' AS declared_version FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'beta', 'beta; extra == ''x''' FROM customer""",
)
def pypi_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    rows = artifacts.pypi_dependencies(artifacts.pypi_manifests(_pkg_info(spark, sf)))
    return rows.select("artifact_sha256", "dependency_name", "declared_version")


@query(
    "b16_metadata_findings",
    """SELECT CAST(c_custkey AS VARCHAR) AS artifact_sha256, 'package-metadata' AS rule_id, 'info' AS severity, 'd/PKG-INFO' AS subject_path,
    c_name || '@1.' || c_custkey AS evidence, 'unreviewed' AS disposition FROM customer""",
)
def metadata_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = artifacts.metadata_findings(artifacts.pypi_manifests(_pkg_info(spark, sf)), default_rules(), "pypi")
    return found.select("artifact_sha256", "rule_id", "severity", "subject_path", "evidence", "disposition")


@query(
    "b19_run_records",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN doc_id % 3 = 0 THEN 'resolve' WHEN doc_id % 5 = 0 THEN 'integrity' END AS error_stage,
    sha256(CASE WHEN doc_id % 3 = 0 THEN 'no package' WHEN doc_id % 5 = 0 THEN
      CASE WHEN strlen(text) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(0, 1001), lambda i: strlen(left(text, i)) <= 1000))) END END) AS message_digest
    FROM documents""",
)
def run_records(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(doc % 3 == 0, "no package").alias("resolve_error"), F.when(doc % 5 == 0, F.col("text")).alias("integrity_error")
    )
    return artifacts.run_records(rows, "1").select("doc_id", "status", "error_stage", F.sha2("error_message", 256).alias("message_digest"))


@query(
    "b20_without_known_runs",
    with_views(
        """SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR)) AS artifact_sha256 FROM orders
        WHERE o_custkey NOT IN (SELECT id FROM runs WHERE status = 'completed' AND analyzer_version = '1')""",
        "runs",
    ),
)
def without_known_runs(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select(
        "o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("artifact_sha256"), F.lit("1").alias("analyzer_version")
    )
    left = artifacts.without_known_runs(wanted, v.runs(spark, sf), ["artifact_sha256", "analyzer_version"])
    return left.select("o_orderkey", "artifact_sha256")


@query(
    "j20_reusable_runs",
    with_views(
        """SELECT package_id, analyzer_version, ruleset_version, max(id) AS run_id FROM runs WHERE status = 'completed' GROUP BY 1, 2, 3""", "runs"
    ),
)
def reusable_runs(spark: SparkSession, sf: str) -> DataFrame:
    return artifacts.reusable_runs(v.runs(spark, sf), ["package_id", "analyzer_version", "ruleset_version"])


@query(
    "v28_contract_violations",
    with_views(
        """SELECT id, l_partkey, CASE WHEN analysis_run_id % 10 = 3 THEN 'confidence' WHEN analysis_run_id % 10 = 5 THEN 'evidence too long'
        WHEN analysis_run_id % 10 = 7 THEN 'line number' END AS problem FROM findings WHERE analysis_run_id % 10 IN (3, 5, 7)""",
        "findings",
    ),
)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("analysis_run_id") % 10
    rows = v.findings(spark, sf).select(
        "*",
        F.when(kind == 3, "sure").otherwise("high").alias("confidence"),
        F.lit("a.js").alias("subject_path"),
        F.when(kind == 5, F.repeat(F.lit("x"), 257)).otherwise("x").alias("evidence"),
        F.when(kind == 7, 0).otherwise(1).alias("line_number"),
    )
    return artifacts.contract_violations(rows).select("id", "l_partkey", "problem")


def _brand_document(spark: SparkSession, sf: str, symbol: Column) -> DataFrame:
    """(value) of one row: the built-in document with a rule for each brand instead of its own for modules. There are few brands."""
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"))
    severity = F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), (1 + F.length("p_brand") % len(SEVERITIES)).cast("int"))
    rule = F.struct(symbol.alias("symbol"), F.array(F.lower("p_brand")).alias("tokens"), severity.alias("severity"))
    rules = brands.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", rule.alias("r")))), lambda x: x["r"])).alias("rules"))
    rest = json.dumps({k: x for k, x in default_document().items() if k != "node_builtin_rules"})
    return rules.select(F.concat(F.lit(rest[:-1] + ', "node_builtin_rules": '), "rules", F.lit("}")).alias("value"))


def _brand_severity() -> str:
    return f"[{', '.join(repr(x) for x in SEVERITIES)}][1 + length(p_brand) % {len(SEVERITIES)}]"


@query(
    "s9_loaded_rules",
    f"""SELECT 'node-builtin:' || p_brand AS rule_id, p_brand AS symbol, {_brand_severity()} AS severity, 'Node built-in import: ' || p_brand AS title
    FROM (SELECT DISTINCT p_brand FROM part)""",
)
def loaded_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule document written as a file, loaded, and its line rules as a table."""
    path = scratch(spark, "rules")
    _brand_document(spark, sf, F.col("p_brand")).coalesce(1).write.text(path)
    loaded = load_rules(spark, f"{path}/part-*")
    return rule_table(spark, loaded).filter("detector = 'quoted'").select("rule_id", "symbol", "severity", "title")


@query(
    "v17_rule_problems",
    """WITH b AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS k, left(p_brand, 7) AS symbol FROM (SELECT DISTINCT p_brand FROM part))
    SELECT 'node_builtin_rules[' || k || '].symbol' AS place, symbol || ' stands twice' AS problem FROM b
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k) > 1""",
)
def document_problems(spark: SparkSession, sf: str) -> DataFrame:
    """All problems of a document whose rules share symbols."""
    doc = json.loads(_brand_document(spark, sf, F.substring("p_brand", 1, 7)).first()[0])  # one document of bounded size
    return spark.createDataFrame(rule_problems(doc), "place string, problem string")


_RESULTS = """SELECT id AS package_id, CASE WHEN position = 2 THEN upper(replace(identifier, '-', '__')) ELSE identifier END AS package_name,
CASE WHEN position = 3 THEN 'v' || replace(version, '.0', '') WHEN position = 5 THEN version || '.1' ELSE version END AS package_version,
CASE WHEN position = 4 THEN 'r2' ELSE 'r1' END AS ruleset_version FROM packages"""


@query(
    "v28_identity_violations",
    with_views(
        """SELECT r.*, CASE WHEN p.id IS NULL THEN 'unknown package' WHEN r.ruleset_version <> 'r1' THEN 'ruleset' ELSE 'package identity' END AS problem
        FROM results r LEFT JOIN (SELECT * FROM packages WHERE position <> 7) p ON p.id = r.package_id
        WHERE p.id IS NULL OR p.position IN (4, 5) OR p.version IS NULL OR (p.position IN (2, 3) AND p.registry_type = 'npm')""",
        "packages",
        results=_RESULTS,
    ),
)
def identity_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Reported names and versions in other spellings, another ruleset, other versions, packages that nobody asked for."""
    packages = v.packages(spark, sf)
    at = F.col("position")
    results = packages.select(
        F.col("id").alias("package_id"),
        F.when(at == 2, F.upper(F.replace("identifier", F.lit("-"), F.lit("__")))).otherwise(F.col("identifier")).alias("package_name"),
        F.when(at == 3, F.concat(F.lit("v"), F.replace("version", F.lit(".0"), F.lit(""))))
        .when(at == 5, F.concat("version", F.lit(".1")))
        .otherwise(F.col("version"))
        .alias("package_version"),
        F.when(at == 4, "r2").otherwise("r1").alias("ruleset_version"),
    )
    return artifacts.identity_violations(results, packages.filter(at != 7), "r1")


def _finding_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = _page_findings(spark, sf).filter("kind = 'page'").select(F.col("id").alias("page_id"), "line_number", "symbol", "rule_id")
    pages = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return found.join(pages, "page_id")


@query(
    "b18_source_windows",
    f"""WITH l AS ({_LINES}), f AS ({" UNION ALL ".join(f"SELECT kind, id, line_number, '{i}' AS rule_id FROM l WHERE {c}" for i, c in _CONDITIONS.items())})
    SELECT id AS page_id, rule_id, strlen(html) > 600 AS truncated, least(strlen(html), 600) - 3 <= strlen(html) AS bounded FROM f JOIN pages ON page_id = id WHERE kind = 'page'""",
)
def source_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of at most 600 bytes; every window lies inside its text and respects the limit."""
    window = artifacts.source_window(F.col("content"), F.col("line_number"), F.col("symbol"), F.lit(None).cast("string"), 600)
    rows = _finding_lines(spark, sf).withColumn("w", window)
    size = F.col("w.display_end") - F.col("w.display_start")
    within = (size <= 600) & (F.octet_length("w.content") == size) & (size >= F.least(F.octet_length("content"), F.lit(600)) - 6)
    return rows.select(
        "page_id", "rule_id", (F.col("w.truncated_before") | F.col("w.truncated_after")).alias("truncated"), within.alias("bounded")
    )


def _window_sql(limit: int) -> str:
    """Windows of all line findings of pages and documents, step by step over the bytes of each text."""
    symbols = ", ".join(f"('{r.rule_id}', '{r.symbol.replace(chr(39), chr(39) * 2)}')" for r in page_rules().line_rules)
    continues = "hex(b[{0} + 1:{0} + 1]) BETWEEN '80' AND 'BF'"

    def stepped(at: str, step: int) -> str:
        places = [f"{at} + {k * step}" for k in range(4)]
        return "CASE " + " ".join(f"WHEN NOT {continues.format(f'({x})')} THEN {x}" for x in places[:3]) + f" ELSE {places[3]} END"

    return f"""WITH l AS ({_LINES}),
    f AS ({" UNION ALL ".join(f"SELECT kind, id, line_number, '{i}' AS rule_id FROM l WHERE {c}" for i, c in _CONDITIONS.items())}),
    texts AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'doc', doc_id, text FROM documents),
    s(rule_id, symbol) AS (VALUES {symbols}),
    a AS (SELECT f.*, symbol, encode(text) AS b, strlen(text) AS total, string_split(text, chr(10)) AS parts FROM f JOIN texts USING (kind, id) JOIN s USING (rule_id)),
    c AS (SELECT *, CASE WHEN line_number > 1 THEN least(strlen(array_to_string(parts[1:line_number - 1], chr(10))) + 1, total) ELSE 0 END AS low,
        strlen(array_to_string(parts[1:line_number], chr(10))) AS high FROM a),
    d AS (SELECT *, decode(b[low + 1:high]) AS body FROM c),
    e AS (SELECT *, CASE WHEN instr(body, symbol) > 0 THEN low + strlen(left(body, instr(body, symbol) - 1)) + strlen(symbol) // 2 ELSE low + (high - low) // 2 END AS middle FROM d),
    g AS (SELECT *, CASE WHEN total <= {limit} THEN 0 WHEN greatest(0, middle - {limit // 2}) + {limit} >= total THEN total - {limit} ELSE greatest(0, middle - {limit // 2}) END AS from_,
        CASE WHEN total <= {limit} OR greatest(0, middle - {limit // 2}) + {limit} >= total THEN total ELSE greatest(0, middle - {limit // 2}) + {limit} END AS to_ FROM e),
    h AS (SELECT *, CASE WHEN from_ > 0 THEN {stepped("from_", 1)} ELSE from_ END AS begin_, CASE WHEN to_ < total THEN {stepped("to_", -1)} ELSE to_ END AS end_ FROM g)
    SELECT kind, id, rule_id, line_number, begin_ AS display_start, end_ AS display_end, 1 + len(string_split(decode(b[1:begin_]), chr(10))) - 1 AS start_line,
        begin_ > 0 AS truncated_before, end_ < total AS truncated_after, sha256(decode(b[begin_ + 1:end_])) AS shown FROM h"""


@query("b18_window_offsets", _window_sql(600))
def window_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets, lines and texts of the windows of all findings, of documents as well as of pages."""
    texts = _texts(spark, sf).select("kind", "id", F.encode("text", "UTF-8").alias("content"))
    found = _page_findings(spark, sf).select("kind", "id", "line_number", "symbol", "rule_id").join(texts, ["kind", "id"])
    window = artifacts.source_window(F.col("content"), F.col("line_number"), F.col("symbol"), F.lit(None).cast("string"), 600)
    return found.withColumn("w", window).select(
        "kind", "id", "rule_id", F.col("line_number").cast("bigint").alias("line_number"),
        *[F.col(f"w.{c}").cast("bigint").alias(c) for c in ("display_start", "display_end", "start_line")],
        "w.truncated_before", "w.truncated_after", F.sha2("w.content", 256).alias("shown"),
    )


@query(
    "j9_finding_sources",
    f"""WITH f AS ({_FILES}) SELECT path AS subject_path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_size, CAST(NULL AS VARCHAR) AS error,
    sha256(text) AS shown FROM f WHERE doc_id % 16 IN (5, 6, 10)
    UNION ALL SELECT path, sha256(t), strlen(t), NULL, sha256(t) FROM (SELECT *, CASE WHEN doc_id % 16 = 14 THEN chr(127) || 'ELF' ELSE '' END || text AS t FROM f WHERE {_NATIVE})""",
)
def finding_sources(spark: SparkSession, sf: str) -> DataFrame:
    """File-type findings of text members, joined to run, file, evidence and member."""
    members = _members(spark, sf)
    rules = default_rules()
    inventory = artifacts.file_inventory(members, rules)
    digests_ = members.select("artifact_sha256").distinct()
    runs = digests_.select(F.xxhash64("artifact_sha256").alias("id"), "artifact_sha256")
    run_of = F.xxhash64("artifact_sha256").alias("analysis_run_id")
    notable = artifacts.file_type_findings(inventory, rules)
    found = notable.select(F.xxhash64("subject_path").alias("id"), run_of, "subject_path", "line_number", "symbol", "evidence")
    files = inventory.select(run_of, "archive_path", "byte_size", "sha256")
    placed = F.concat(F.lit("artifacts/sha256/"), F.substring("artifact_sha256", 1, 2), F.lit("/"), "artifact_sha256", F.lit("/artifact.tgz"))
    evidence = runs.select(
        F.lit(1).alias("id"), F.col("id").alias("analysis_run_id"), F.lit("artifact").alias("evidence_type"), placed.alias("relative_path"),
        F.col("artifact_sha256").alias("sha256"), F.lit(0).cast("bigint").alias("byte_size"),
    )
    rows = artifacts.finding_sources(found, runs, files, evidence, members, limit=1 << 20)
    return rows.select("subject_path", "sha256", F.col("byte_size").cast("bigint").alias("byte_size"), "error", F.sha2("content", 256).alias("shown"))


@query(
    "k7_k10_exported_details",
    f"""WITH f AS ({_FILES}) SELECT path AS subject_path, CASE WHEN {_NATIVE} THEN 'file-type:native' ELSE 'file-type:' || file_type END AS rule_id, TRUE AS placed FROM f
    WHERE {_NATIVE} OR file_type IN ('shell_script', 'powershell_script', 'nested_archive')""",
)
def exported_details(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    rules = default_rules()
    inventory = artifacts.file_inventory(members, rules)
    found = artifacts.file_type_findings(inventory, rules)
    root = scratch(spark, "export")
    nothing = inventory.select("artifact_sha256", F.lit("x").alias("dependency_name")).limit(0)
    export_details(found, inventory, nothing, root)
    back = spark.read.schema("artifact_sha256 string, rule_id string, subject_path string, sha_prefix string").json(f"{root}/findings")
    return back.select("subject_path", "rule_id", F.startswith("artifact_sha256", "sha_prefix").alias("placed"))

"""Scalar function and row check queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, digests, documents, text, urls
from ..operators import artifacts
from ..sources import releases
from . import views as v
from .views import query, table, with_views


def _s(name: str) -> Column:
    return F.col(name).cast("string")


UPPER, LOWER = text.UPPER, text.LOWER


@query("f5_lower_ascii", f"SELECT doc_id, sha256(translate(text, '{UPPER}', '{LOWER}')) AS digest FROM documents")
def lower_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.lower_ascii("text"), 256).alias("digest"))


@query("f6_percent_encode", "SELECT doc_id, sha256(url_encode(text)) AS digest FROM documents")
def percent_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.percent_encode("text"), 256).alias("digest"))


_URL_FORMS = """SELECT page_id, form, CASE form WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user@')
WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:8443') WHEN 3 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:99999')
WHEN 4 THEN 'HTTPS://GitHub.com/o' || CAST(page_id AS VARCHAR) || '/r' || CAST(page_id AS VARCHAR) || '.git?x=' || url
WHEN 5 THEN replace(url, 'http', 'Http') WHEN 6 THEN 'https://gitlab.com/a/b/' || CAST(page_id AS VARCHAR) ELSE replace(url, '://', ':/') END AS url
FROM pages, range(0, 8) t(form)"""


def _url_forms(spark: SparkSession, sf: str) -> DataFrame:
    url, page = F.col("url"), _s("page_id")
    with_port = [F.regexp_replace(url, "^(https?://[^/]+)", f"$1:{p}") for p in ("8443", "99999")]
    forms = [
        url,
        F.replace(url, F.lit("://"), F.lit("://user@")),
        *with_port,
        F.concat(F.lit("HTTPS://GitHub.com/o"), page, F.lit("/r"), page, F.lit(".git?x="), url),
        F.replace(url, F.lit("http"), F.lit("Http")),
        F.concat(F.lit("https://gitlab.com/a/b/"), page),
        F.replace(url, F.lit("://"), F.lit(":/")),
    ]
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "url")).withColumn(
        "form", F.col("form").cast("bigint")
    )


@query(
    "f7_url_parts",
    f"""WITH f AS ({_URL_FORMS}), s AS (SELECT *, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^(.+?)://', 1)) END AS scheme,
      regexp_replace(url, '^.+?://', '') AS rest FROM f),
    a AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS authority FROM s),
    p AS (SELECT *, CASE WHEN contains(authority, ':') THEN TRY_CAST(regexp_extract(authority, ':([0-9]+)$', 1) AS INTEGER) END AS raw_port FROM a),
    h AS (SELECT *, scheme IS NOT NULL AND authority <> '' AND NOT contains(authority, '@') AND (raw_port IS NULL OR raw_port <= 65535) AS fine FROM p)
    SELECT page_id, form, scheme, CASE WHEN fine THEN lower(regexp_replace(authority, ':[0-9]+$', '')) END AS host,
      CASE WHEN fine THEN raw_port END AS port,
      CASE WHEN fine AND lower(authority) = 'github.com' THEN regexp_extract(rest, '^[^/]+/([^/]+)/', 1) END AS owner,
      CASE WHEN fine AND lower(authority) = 'github.com' THEN regexp_replace(regexp_extract(rest, '^[^/]+/[^/]+/([^/?#]+)', 1), '\\.git$', '') END AS repository_name
    FROM h""",
)
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _url_forms(spark, sf).select("page_id", "form", urls.url_parts("url", True).alias("u")).select("page_id", "form", "u.*")


@query(
    "f8_registry_base",
    """WITH f AS (SELECT page_id, form, CASE form WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '[?#].*$', '') WHEN 2 THEN
      regexp_replace(regexp_replace(url, '^http:', 'https:'), '[?#].*$', '//') ELSE 'http://LOCALHOST:80/p' || CAST(page_id AS VARCHAR) || '/' END AS url
      FROM pages, range(0, 4) t(form)),
    e AS (SELECT *, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?:]*)', 1)) AS host,
      regexp_replace(regexp_extract(url, '^[a-z]+://[^/?]*(.*)$', 1), '/+$', '') AS path FROM f)
    SELECT page_id, form, CASE WHEN contains(url, '#') THEN 'registry URL fragments are rejected'
      WHEN scheme = 'http' AND host <> 'localhost' THEN 'plain HTTP is allowed only for explicit local hosts'
      WHEN contains(url, '?') THEN 'registry base URL query is not supported' END AS error,
      CASE WHEN NOT contains(url, '#') AND NOT contains(url, '?') AND (scheme = 'https' OR host = 'localhost')
        THEN scheme || '://' || host || path END AS normalized FROM e""",
)
def registry_base(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    forms = [
        url,
        F.regexp_replace(url, "[?#].*$", ""),
        F.regexp_replace(F.regexp_replace(url, "^http:", "https:"), "[?#].*$", "//"),
        F.concat(F.lit("http://LOCALHOST:80/p"), _s("page_id"), F.lit("/")),
    ]
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "u"))
    base = urls.registry_base("u")
    return rows.select("page_id", F.col("form").cast("bigint").alias("form"), base["error"].alias("error"), base["normalized"].alias("normalized"))


@query(
    "f9_api_url",
    """SELECT page_id, 'https://r.example/v0.1/servers?' || CASE WHEN page_id % 2 = 0 THEN 'updated_since=2024-01-01T00%3A00%3A00Z&' ELSE '' END
    || 'cursor=' || url_encode(url) AS url FROM pages""",
)
def api_url(spark: SparkSession, sf: str) -> DataFrame:
    since = F.when(F.col("page_id") % 2 == 0, "2024-01-01T00:00:00Z")
    return table(spark, sf, "pages").select("page_id", urls.api_url(F.lit("https://r.example"), "url", since).alias("url"))


_TIME = """printf('%04d-%02d-%02dT%02d:%02d:%02dZ', CAST(year(o_orderdate) AS INTEGER), CAST(o_orderkey % 15 AS INTEGER), CAST(o_orderkey % 34 AS INTEGER),
CAST(o_custkey % 26 AS INTEGER), CAST(o_custkey % 62 AS INTEGER), CAST(o_orderkey % 63 AS INTEGER))"""
_TIME_OK = "o_orderkey % 15 BETWEEN 1 AND 12 AND o_orderkey % 34 BETWEEN 1 AND 31 AND o_custkey % 26 <= 23 AND o_custkey % 62 <= 59"


def _times(spark: SparkSession, sf: str) -> DataFrame:
    def part(name: str, modulus: int) -> Column:
        return (F.col(name) % modulus).cast("int")

    stamp = F.format_string(
        "%04d-%02d-%02dT%02d:%02d:%02dZ",
        F.year("o_orderdate"),
        part("o_orderkey", 15),
        part("o_orderkey", 34),
        part("o_custkey", 26),
        part("o_custkey", 62),
        part("o_orderkey", 63),
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", stamp.alias("t"))


@query(
    "v1_utc_timestamp",
    f"""SELECT o_orderkey, {_TIME_OK} AND o_orderkey % 63 <= 59 AS registry_ok, {_TIME_OK} AND o_orderkey % 63 <= 60 AS observation_ok FROM orders""",
)
def utc_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).select(
        "o_orderkey",
        checks.valid_utc_timestamp("t").alias("registry_ok"),
        checks.valid_utc_timestamp("t", 60).alias("observation_ok"),
    )


@query(
    "f10_stable_observed_at",
    f"""SELECT o_orderkey, CASE WHEN {_TIME_OK} AND o_orderkey % 63 <= 59 THEN {_TIME} WHEN o_orderstatus = 'F' THEN '2024-02-31T00:00:00Z'
    ELSE '1970-01-01T00:00:00Z' END AS observed_at FROM orders""",
)
def stable_observed_at(spark: SparkSession, sf: str) -> DataFrame:
    published = F.when(F.col("o_orderstatus") == "F", "2024-02-31T00:00:00Z")
    return _times(spark, sf).select("o_orderkey", checks.stable_observed_at("t", published).alias("observed_at"))


@query(
    "v2_server_name",
    """WITH n AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN replace(c_name, '#', '/') WHEN 1 THEN replace(c_name, '#', '//') WHEN 2 THEN c_name
      ELSE lower(c_mktsegment) || '/_' || c_name END AS name FROM customer)
    SELECT c_custkey, regexp_matches(name, '^[A-Za-z0-9.-]+/[A-Za-z0-9._-]+$') AND length(name) BETWEEN 3 AND 200 AS valid FROM n""",
)
def server_name(spark: SparkSession, sf: str) -> DataFrame:
    kind, name = F.col("c_nationkey") % 4, F.col("c_name")
    made = (
        F.when(kind == 0, F.replace(name, F.lit("#"), F.lit("/")))
        .when(kind == 1, F.replace(name, F.lit("#"), F.lit("//")))
        .when(kind == 2, name)
        .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("/_"), name))
    )
    return table(spark, sf, "customer").select("c_custkey", checks.valid_server_name(made).alias("valid"))


@query(
    "v3_server_version",
    "SELECT doc_id, strlen(text) BETWEEN 1 AND 255 AND NOT regexp_matches(text, '[\\x00-\\x1F\\x7F]') AS valid FROM documents",
)
def server_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", checks.valid_server_version("text").alias("valid"))


@query(
    "f12_contains_prefix",
    f"""SELECT doc_id, contains(translate(text, '{UPPER}', '{LOWER}'), 'the%') AS wildcard, contains(translate(text, '{UPPER}', '{LOWER}'), 'leaux') AS found,
    starts_with(translate(text, '{UPPER}', '{LOWER}'), 'the') AS prefix FROM documents""",
)
def contains_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        text.contains_ascii_ci("text", "The%").alias("wildcard"),
        text.contains_ascii_ci("text", "LEAUX").alias("found"),
        text.startswith_ascii_ci("text", "THE").alias("prefix"),
    )


@query(
    "f13_tokens",
    """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS BIGINT) AS n,
    list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1] AS first FROM documents""",
)
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = text.tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.get(t, F.lit(0)).alias("first"))


@query(
    "f15_project_name",
    """WITH n AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN replace(c_name, '#', '_.-') WHEN 1 THEN c_name ELSE '-' || c_mktsegment END AS name FROM customer)
    SELECT c_custkey, CASE WHEN regexp_matches(name, '^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?$') THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) END AS name FROM n""",
)
def project_name(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_nationkey") % 3
    made = (
        F.when(kind == 0, F.replace("c_name", F.lit("#"), F.lit("_.-")))
        .when(kind == 1, F.col("c_name"))
        .otherwise(F.concat(F.lit("-"), "c_mktsegment"))
    )
    return table(spark, sf, "customer").select("c_custkey", text.normalize_project_name(made).alias("name"))


_LABELS = ("", "-beta", "b1", ".rc", "rc2", "-alpha3", ".post1", "preview")
_VERSIONS = f"""SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN 'v' ELSE '' END || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR)
|| CASE WHEN p_partkey % 2 = 0 THEN '.0.00' ELSE '' END || ({list(_LABELS)!r})[1 + CAST(p_partkey % 8 AS INTEGER)] AS version FROM part"""


@query(
    "f16_version_identity",
    f"""WITH n AS ({_VERSIONS})
    SELECT p_partkey, CASE WHEN p_partkey % 8 = 6 THEN NULL ELSE CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' || CAST(p_partkey % 7 AS VARCHAR) END END AS release,
    CASE p_partkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 0 WHEN 7 THEN 2 END AS kind,
    CASE p_partkey % 8 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 0 END AS serial FROM n""",
)
def version_identity(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    made = F.concat(
        F.when(key % 3 == 0, "v").otherwise(""),
        _s("p_size"),
        F.lit("."),
        (key % 7).cast("string"),
        F.when(key % 2 == 0, ".0.00").otherwise(""),
        F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (1 + key % 8).cast("int")),
    )
    ident = text.version_identity(made)
    release = F.array_join(F.transform(ident["release"], lambda d: d.cast("string")), ".")
    return table(spark, sf, "part").select(
        "p_partkey", F.when(ident.isNotNull(), release).alias("release"), ident["kind"].alias("kind"), ident["serial"].cast("int").alias("serial")
    )


EXTENSIONS = (".js", ".d.ts", ".ts", ".py", ".map", ".sh", ".PS1", ".node", ".so", ".wasm", ".tar.gz", ".json", ".md", ".txt", "", ".bin")
_TYPES = (
    "javascript", "typescript_declaration", "typescript", "python", "source_map", "shell_script", "powershell_script", "native_node_module",
    "shared_library", "wasm", "nested_archive", "json", "markdown", "text", "elf", "other",
)
_EXT_SQL = f"({list(EXTENSIONS)!r})[1 + CAST(doc_id % 16 AS INTEGER)]"


def extension_of(doc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (1 + doc % 16).cast("int"))


def document_path() -> Column:
    return F.concat(F.lit("package/"), "source", F.lit("/doc"), _s("doc_id"), extension_of(F.col("doc_id")))


@query(
    "f18_file_type",
    f"""SELECT doc_id, lower(regexp_extract({_EXT_SQL}, '(\\.[^.]*)$', 1)) AS extension, ({list(_TYPES)!r})[1 + CAST(doc_id % 16 AS INTEGER)] AS file_type FROM documents""",
)
def file_type(spark: SparkSession, sf: str) -> DataFrame:
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 16 == 14, F.concat(F.unhex(F.lit("7F454C46")), body)).otherwise(body)
    return table(spark, sf, "documents").select(
        "doc_id", text.file_extension(document_path()).alias("extension"), artifacts.file_type(document_path(), content).alias("file_type")
    )


@query(
    "f19_minified",
    "SELECT page_id, strlen(html) > 4096 AND length(html) - length(replace(html, chr(10), '')) < 3 AS minified FROM pages",
)
def minified(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.looks_minified("html").alias("minified"))


def _prefix(limit: int, tail: str) -> str:
    longest = f"list_max(list_filter(range(0, {limit} + 1), lambda i: strlen(left(text, i)) <= {limit}))"
    return f"CASE WHEN strlen(text) <= {limit} THEN text ELSE left(text, {longest}) || '{tail}' END"


@query("f21_snippet", f"SELECT doc_id, {_prefix(240, '...')} AS snippet FROM documents")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.bound_snippet("text").alias("snippet"))


@query("f22_message", f"SELECT doc_id, sha256({_prefix(2048, '…')}) AS digest FROM documents")
def message(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.bounded_message("text"), 256).alias("digest"))


@query(
    "f23_archive_path",
    r"""SELECT page_id, regexp_replace(replace(replace(url, 'http', '//'), '/en/', '\'), '^/+', '') AS x,
    regexp_replace(replace(replace(replace(url, 'http', '//'), '/en/', '\'), '\', '/'), '^/+', '') AS path FROM pages""",
)
def archive_path(spark: SparkSession, sf: str) -> DataFrame:
    made = F.replace(F.replace("url", F.lit("http"), F.lit("//")), F.lit("/en/"), F.lit("\\"))
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(made, "^/+", "").alias("x"), text.normalize_archive_path(made).alias("path")
    )


@query(
    "f24_profile_key",
    """SELECT s_suppkey, sha256('{"analyzer":"' || s_name || '","rules":"' || CAST(s_nationkey AS VARCHAR) || '","version":"1"}') AS profile_key FROM supplier""",
)
def profile_key(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"version": F.lit("1"), "analyzer": F.col("s_name"), "rules": F.col("s_nationkey")}
    return table(spark, sf, "supplier").select("s_suppkey", digests.profile_key(fields).alias("profile_key"))


@query(
    "f25_f26_prefix_recency",
    with_views(
        "SELECT id, substr(canonical_sha256, 1, 16) AS prefix, coalesce(updated_at, published_at, '') AS recency FROM versions", "versions"
    ),
)
def prefix_recency(spark: SparkSession, sf: str) -> DataFrame:
    return v.versions(spark, sf).select(
        "id", text.digest_prefix("canonical_sha256").alias("prefix"), text.recency_key("updated_at", "published_at").alias("recency")
    )


@query(
    "f3_f4_digests",
    """SELECT doc_id, sha256(text) AS sha256, 'sha256-' || to_base64(unhex(sha256(text))) AS sri,
    'sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS placed FROM documents""",
)
def digest_forms(spark: SparkSession, sf: str) -> DataFrame:
    body = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id",
        digests.sha256_hex(body).alias("sha256"),
        digests.subresource_integrity(body, 256).alias("sri"),
        digests.content_address(digests.sha256_hex(body)).alias("placed"),
    )


@query(
    "v26_integrity",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'npm integrity mismatch' WHEN 2 THEN 'unsupported npm integrity algorithm'
      ELSE 'invalid npm integrity format' END AS npm_error,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PyPI SHA-256 integrity mismatch' WHEN 2 THEN 'PyPI artifact size does not match release metadata'
      ELSE 'invalid PyPI SHA-256 digest' END AS pypi_error FROM documents""",
)
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    body, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 4
    wrong = F.concat(F.lit("x"), "text")
    sri = (
        F.when(kind == 0, digests.subresource_integrity(body))
        .when(kind == 1, digests.subresource_integrity(F.encode(wrong, "UTF-8")))
        .when(kind == 2, F.concat(F.lit("md5-"), F.base64(F.unhex(F.md5(body)))))
        .otherwise(F.sha2(body, 256))
    )
    sha = F.when(kind == 1, F.sha2(wrong, 256)).when(kind == 3, "zz").otherwise(F.upper(F.sha2(body, 256)))
    size = F.octet_length(body) + F.when(kind == 2, 1).otherwise(0)
    return table(spark, sf, "documents").select(
        "doc_id", digests.npm_integrity_error(body, sri).alias("npm_error"), digests.pypi_integrity_error(body, sha, size).alias("pypi_error")
    )


@query(
    "v27_descriptor_rules",
    """SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 'package name and version must be non-empty bounded visible strings'
      WHEN page_id % 11 = 5 THEN 'artifact filename must be a bounded basename'
      WHEN starts_with(url, 'http://') OR contains(url, '#') THEN 'artifact URL must be HTTPS without credentials or fragment'
      WHEN page_id % 11 = 7 THEN 'artifact SHA-256 must contain exactly 64 hexadecimal characters'
      WHEN page_id % 11 = 9 THEN 'artifact size is zero or exceeds the configured acquisition limit' END AS error FROM pages""",
)
def descriptor_rules(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("page_id") % 11
    error = checks.descriptor_error(
        F.when(kind == 3, "a b").otherwise("name"),
        F.lit("1.0"),
        F.when(kind == 5, "a/b.tgz").otherwise("b.tgz"),
        "url",
        F.when(kind == 7, "abc").otherwise(F.sha2("html", 256)),
        F.when(kind == 9, 0).otherwise(F.octet_length("html")),
    )
    return table(spark, sf, "pages").select("page_id", error.alias("error"))


@query(
    "f28_displayable",
    "SELECT doc_id, doc_id % 5 NOT IN (2, 4) AS displayable FROM documents",
)
def displayable(spark: SparkSession, sf: str) -> DataFrame:
    body, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 5
    content = (
        F.when(kind == 2, F.concat(body, F.unhex(F.lit("C328"))))
        .when(kind == 4, F.concat(body, F.unhex(F.lit("00"))))
        .otherwise(body)
    )
    return table(spark, sf, "documents").select("doc_id", text.displayable_utf8(content).alias("displayable"))


@query(
    "f29_throughput",
    """WITH g AS (SELECT o_custkey, sum(CAST(o_orderkey AS BIGINT)) AS elapsed, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
      count(*) FILTER (WHERE o_orderstatus <> 'F') AS waiting FROM orders GROUP BY 1)
    SELECT o_custkey, round(CAST(elapsed AS DOUBLE) / nullif(done, 0), 3) AS mean_seconds_per_processed_record,
      CAST(round(CAST(elapsed AS DOUBLE) / nullif(done, 0) * waiting) AS BIGINT) AS estimated_remaining_seconds FROM g""",
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_orderkey").cast("double").alias("elapsed"), F.count_if(done).alias("done"), F.count_if(~done).alias("waiting")
    )
    return rows.select("o_custkey", text.throughput(F.col("elapsed"), F.col("done"), F.col("waiting")).alias("t")).select("o_custkey", "t.*")


NOW = "1999-06-01 00:00:00"


@query(
    "f30_retry_due",
    with_views(
        f"""SELECT package_id, last_attempt_at IS NULL OR CAST(last_attempt_at AS TIMESTAMP) <= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND AS due FROM queue""",
        "queue",
    ),
)
def retry_due(spark: SparkSession, sf: str) -> DataFrame:
    return v.queue(spark, sf).select("package_id", text.retry_due("last_attempt_at", NOW, 86400).alias("due"))


# --- eligibility and failure classes -------------------------------------------------------

_REG = "CASE l_returnflag WHEN 'A' THEN ' NPM ' WHEN 'N' THEN 'pypi' ELSE 'oci' END"
_TRA = "CASE WHEN l_linestatus = 'F' THEN 'stdio' ELSE 'sse' END"
_IDT = "CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'p' END"
_VER = "CASE WHEN l_discount > 0.08 THEN NULL ELSE '1' END"


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", " NPM ").when(flag == "N", "pypi").otherwise("oci").alias("registry"),
        F.when(F.col("l_linestatus") == "F", "stdio").otherwise("sse").alias("transport"),
        F.when(F.col("l_linenumber") == 7, " ").otherwise("p").alias("identifier"),
        F.when(~(F.col("l_discount") > 0.08), "1").alias("version"),
    )


def _counted(rows: DataFrame, verdict: Column) -> DataFrame:
    return (
        rows.select(verdict.alias("s"))
        .select("s.*")
        .groupBy("state", "reason_code", "reason_message")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_DECLARED = f"SELECT {_REG} AS registry, {_TRA} AS transport, {_IDT} AS identifier, {_VER} AS version FROM lineitem"


@query(
    "v21_static_eligibility",
    f"""WITH d AS ({_DECLARED}), c AS (SELECT CASE WHEN registry = 'oci' THEN 'unsupported' WHEN trim(identifier) = '' OR version IS NULL THEN 'unresolvable' ELSE 'eligible' END AS state,
    CASE WHEN registry = 'oci' THEN 'unsupported_registry' WHEN trim(identifier) = '' THEN 'missing_package_identifier' WHEN version IS NULL THEN 'missing_exact_version' END AS reason_code,
    CASE WHEN registry = 'oci' THEN 'registry type oci is not supported' WHEN trim(identifier) = '' THEN 'package identifier is missing'
      WHEN version IS NULL THEN 'exact package version is missing' END AS reason_message FROM d)
    SELECT *, count(*) AS n FROM c GROUP BY ALL""",
)
def static_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(_declared(spark, sf), checks.static_eligibility("registry", "identifier", "version"))


@query(
    "v22_runtime_eligibility",
    f"""WITH d AS ({_DECLARED}), c AS (SELECT CASE WHEN registry <> ' NPM ' OR transport <> 'stdio' THEN 'unsupported' WHEN trim(identifier) = '' OR version IS NULL THEN 'unresolvable' ELSE 'eligible' END AS state,
    CASE WHEN registry <> ' NPM ' THEN 'unsupported_ecosystem' WHEN transport <> 'stdio' THEN 'unsupported_transport' WHEN trim(identifier) = '' THEN 'missing_package_identifier'
      WHEN version IS NULL THEN 'missing_exact_version' END AS reason_code,
    CASE WHEN registry <> ' NPM ' THEN 'registry type ' || registry || ' is not npm' WHEN transport <> 'stdio' THEN 'transport sse is not stdio'
      WHEN trim(identifier) = '' THEN 'package identifier is missing' WHEN version IS NULL THEN 'exact npm package version is missing' END AS reason_message FROM d)
    SELECT *, count(*) AS n FROM c GROUP BY ALL""",
)
def runtime_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(_declared(spark, sf), checks.runtime_eligibility("registry", "transport", "identifier", "version"))


_STDERR = "CASE doc_id % 6 WHEN 0 THEN 'Offline Install failed: ' WHEN 1 THEN 'npm integrity mismatch ' WHEN 2 THEN 'No unambiguous executable bin entry ' WHEN 3 THEN CASE WHEN doc_id % 4 = 1 THEN 'Sentry inspect failed ' ELSE 'entry inspect failed ' END ELSE '' END || CASE WHEN doc_id % 6 = 5 THEN '' ELSE text END"


@query(
    "v23_failure_class",
    f"""WITH e AS (SELECT doc_id, {_STDERR} AS stderr FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'unresolvable' WHEN 2 THEN 'unsupported' ELSE 'failed' END AS state,
    CASE doc_id % 6 WHEN 0 THEN 'install_failed' WHEN 1 THEN 'artifact_unresolvable' WHEN 2 THEN 'ambiguous_executable' WHEN 3 THEN CASE WHEN doc_id % 4 = 1 THEN 'protocol_failed' ELSE 'runtime_discovery_failed' END ELSE 'runtime_discovery_failed' END AS reason_code,
    sha256(CASE WHEN doc_id % 6 = 5 THEN 'runtime discovery exited with status 5' ELSE stderr END) AS message_digest,
    CASE WHEN contains(lower(stderr), 'unsupported') OR contains(lower(stderr), 'wheel') OR contains(lower(stderr), 'yanked') OR contains(lower(stderr), 'zip sdist')
      THEN 'artifact_unsupported' ELSE 'artifact_unresolvable' END AS static_code FROM e""",
)
def failure_class(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    head = F.when(kind == 0, "Offline Install failed: ").when(kind == 1, "npm integrity mismatch ").when(kind == 2, "No unambiguous executable bin entry ")
    head = head.when(kind == 3, F.when(F.col("doc_id") % 4 == 1, "Sentry inspect failed ").otherwise("entry inspect failed ")).otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", F.concat(head, F.when(kind == 5, "").otherwise(F.col("text"))).alias("stderr"))
    run, static = checks.runtime_failure("stderr", F.lit(5), "sentry"), checks.static_failure("stderr", F.lit(5))
    return rows.select(
        "doc_id",
        run["state"].alias("state"),
        run["reason_code"].alias("reason_code"),
        F.sha2(run["reason_message"], 256).alias("message_digest"),
        static["reason_code"].alias("static_code"),
    )


# --- strict JSON ---------------------------------------------------------------------------

_LOOSE = """'{ "z" : ' || CAST(p_size AS VARCHAR) || '.0 , "a":"' || p_name || '" , "m": [ 1e3 , true , null ], "k": {"b" : -0.50, "B":"\\u00e9\\n"} }'"""
_CANON = """'{"a":"' || p_name || '","k":{"B":"é\\n","b":-0.50},"m":[1e3,true,null],"z":' || CAST(p_size AS VARCHAR) || '.0}'"""


def _loose() -> Column:
    return F.concat(
        F.lit('{ "z" : '), _s("p_size"), F.lit('.0 , "a":"'), "p_name", F.lit('" , "m": [ 1e3 , true , null ], "k": {"b" : -0.50, "B":"\\u00e9\\n"} }')
    )


@query("f1_canonical_json", f"SELECT p_partkey, {_CANON} AS canonical, sha256({_CANON}) AS digest FROM part")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", documents.canonical_json()(_loose()).alias("canonical"))
    return rows.withColumn("digest", F.sha2("canonical", 256))


@query(
    "f2_compact_json",
    f"""SELECT p_partkey, '{{"z":' || CAST(p_size AS VARCHAR) || '.0,"a":"' || p_name || '","m":[1e3,true,null],"k":{{"b":-0.50,"B":"\\u00e9\\n"}}}}' AS compact FROM part""",
)
def compact_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", documents.compact_json()(_loose()).alias("compact"))


# --- release documents ---------------------------------------------------------------------


@query(
    "s11_npm_releases",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'npm metadata identity mismatch' WHEN p_size % 5 = 0 THEN 'npm metadata missing tarball or integrity' END AS error,
    CASE WHEN p_size % 5 <> 0 THEN 'https://r.example/' || p_partkey || '.tgz' END AS tarball_url, CASE WHEN p_size % 5 <> 0 THEN 'sha512-x' END AS integrity FROM part""",
)
def npm_releases(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    dist = F.when(size % 5 == 0, "{}").otherwise(
        F.concat(F.lit('{"tarball":"https://r.example/'), _s("p_partkey"), F.lit('.tgz","integrity":"sha512-x"}'))
    )
    body = F.concat(F.lit('{"name":"'), "p_name", F.lit('","version":"'), "p_brand", F.lit('","dist":'), dist, F.lit("}"))
    rows = table(spark, sf, "part").select(
        "p_partkey",
        body.alias("body"),
        F.col("p_name").alias("expected_name"),
        F.when(size % 7 == 0, "other").otherwise(F.col("p_brand")).alias("expected_version"),
    )
    return releases.npm_releases(rows).select("p_partkey", "error", "tarball_url", "integrity")


@query(
    "b21_npm_descriptors",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'npm artifact URL must name a .tgz archive' END AS error,
    CASE WHEN page_id % 3 = 0 THEN 'p' || page_id || '.zip' ELSE 'p' || page_id || '.tgz' END AS filename FROM pages""",
)
def npm_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, ".zip").otherwise(".tgz")
    rows = table(spark, sf, "pages").select(
        "page_id",
        F.lit("n").alias("name"),
        F.lit("1").alias("version"),
        F.concat(F.lit("https://r.example/a/p"), _s("page_id"), ending).alias("tarball_url"),
        F.sha2("html", 256).alias("sha256"),
        F.octet_length("html").alias("size"),
    )
    return releases.npm_descriptors(rows).select("page_id", "error", "filename")


_RELEASE_FILES = """SELECT l_orderkey AS release, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'bdist_wheel' ELSE 'sdist' END AS package_type,
'f' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_returnflag = 'R' THEN '.whl' WHEN l_linestatus = 'F' THEN '.tar.gz' ELSE '.zip' END AS filename,
l_discount > 0.06 AS yanked FROM lineitem"""


def _release_files(spark: SparkSession, sf: str) -> DataFrame:
    wheel = F.col("l_returnflag") == "R"
    ending = F.when(wheel, ".whl").when(F.col("l_linestatus") == "F", ".tar.gz").otherwise(".zip")
    name = F.concat(F.lit("f"), _s("l_linenumber"), F.lit("-"), _s("l_partkey"), ending)
    lines = table(spark, sf, "lineitem")
    # a line number may come again in an order, with the same part: the rest of the line stands for the content
    content = F.concat_ws("/", name, *[_s(c) for c in lines.columns if c not in ("l_linenumber", "l_partkey")])
    return lines.select(
        F.col("l_orderkey").alias("release"),
        F.lit("Some.Name").alias("name"),
        F.lit("1.0").alias("version"),
        F.when(wheel, "bdist_wheel").otherwise("sdist").alias("package_type"),
        name.alias("filename"),
        F.concat(F.lit("https://files.example/"), name).alias("url"),
        F.sha2(content, 256).alias("sha256"),
        F.lit(10).cast("bigint").alias("size"),
        (F.col("l_discount") > 0.06).alias("yanked"),
    )


@query(
    "t9_sdist_selection",
    f"""WITH f AS ({_RELEASE_FILES}), g AS (SELECT release, count(*) FILTER (WHERE NOT yanked AND package_type = 'sdist' AND filename LIKE '%.tar.gz') AS n,
      min(CASE WHEN NOT yanked AND package_type = 'sdist' AND filename LIKE '%.tar.gz' THEN filename END) AS first FROM f GROUP BY 1)
    SELECT release, CASE WHEN n > 1 THEN 'PyPI release has multiple supported non-yanked tar-gzip source distributions'
      WHEN n = 0 THEN 'PyPI release has no supported non-yanked tar-gzip source distribution' END AS error,
      CASE WHEN n = 1 THEN first END AS filename FROM g""",
)
def sdist_selection(spark: SparkSession, sf: str) -> DataFrame:
    return releases.select_sdist(_release_files(spark, sf), ["release"], "name", "version").select("release", "error", "filename")


@query(
    "t9_release_candidates",
    f"""WITH f AS ({_RELEASE_FILES}), twice AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE release % 5 = 0 AND l_linenumber = 1),
    v AS (SELECT release, CASE WHEN count(*) FILTER (WHERE NOT yanked AND release % 5 = 0 AND l_linenumber = 1) > 1 THEN 'duplicate PyPI release artifact identity'
      WHEN count(*) FILTER (WHERE NOT yanked) = 0 THEN 'PyPI release has no supported non-yanked wheel or source distribution' END AS error FROM twice GROUP BY 1)
    SELECT release, error, filename, CASE WHEN filename LIKE '%.tar.gz' THEN 'tar_gzip' ELSE 'zip' END AS archive_format,
    CASE WHEN filename LIKE '%.tar.gz' THEN 0 ELSE 1 END AS format_order FROM twice JOIN v USING (release) WHERE error IS NULL AND NOT yanked
    UNION ALL SELECT release, error, NULL, NULL, NULL FROM v WHERE error IS NOT NULL""",
)
def release_candidates(spark: SparkSession, sf: str) -> DataFrame:
    files = _release_files(spark, sf)
    twice = files.unionByName(files.where("release % 5 = 0 AND filename LIKE 'f1-%'"))
    rows = releases.pypi_candidates(twice, ["release"], "name", "version")
    return rows.select("release", "error", "filename", "archive_format", "format_order")


@query(
    "s11_pypi_releases",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'PyPI release metadata identity mismatch' END AS error,
    CASE WHEN p_size % 7 <> 0 THEN position END AS position, CASE WHEN p_size % 7 <> 0 THEN 'd-' || p_partkey || (['.tar.gz', '.whl'])[position + 1] END AS filename,
    CASE WHEN p_size % 7 <> 0 THEN position = 1 END AS yanked FROM part, range(0, 2) t(position) WHERE p_size % 7 <> 0 OR position = 0""",
)
def pypi_releases(spark: SparkSession, sf: str) -> DataFrame:
    key = _s("p_partkey")

    def file(ending: str, kind: str, yanked: str) -> Column:
        return F.concat(
            F.lit('{"filename":"d-'), key, F.lit(f'{ending}","packagetype":"{kind}","url":"https://f.example/d","size":5,"digests":{{"sha256":"a"}},"yanked":{yanked}}}')
        )

    version = F.when(F.col("p_size") % 7 == 0, "2.0").otherwise("1.0-beta")
    body = F.concat(
        F.lit('{"info":{"name":"Demo_'), key, F.lit('","version":"'), version, F.lit('"},"urls":['),
        file(".tar.gz", "sdist", "false"), F.lit(","), file(".whl", "bdist_wheel", "true"), F.lit("]}"),
    )
    rows = table(spark, sf, "part").select(
        "p_partkey", body.alias("body"), F.concat(F.lit("demo-"), key).alias("expected_name"), F.lit("1.0b0").alias("expected_version")
    )
    files = releases.pypi_files(rows)
    return files.select("p_partkey", "error", F.col("position").cast("bigint").alias("position"), "filename", "yanked")

"""Deterministic views of the star-schema tables in the shapes the operators take.

Each view has a DataFrame form and the same definition as SQL text, which the oracle queries use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import looks_minified
from ..operators.explore import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def with_views(body: str, *names: str, **also: str) -> str:
    """SQL text with the named views, those they use, and further common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for used in USES.get(name, ()):
            need(used)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({text})" for n, text in also.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(value: Column) -> Column:
    return value.cast("string")


SQL: dict[str, str] = {}
USES: dict[str, tuple[str, ...]] = {}

# --- daily snapshots of events -------------------------------------------------------------

SQL["day_snapshots"] = """
SELECT id, completed_at, completed_at AS started_at, sha256(completed_at) AS snapshot_sha256
FROM (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS id,
             strftime(ts, '%Y-%m-%dT00:00:00Z') AS completed_at FROM events)"""

SQL["day_links"] = """
SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS snapshot_id,
       user_id AS server_version_id FROM events"""


def _day() -> Column:
    return F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")


def day_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select(
        _day().alias("id"), F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("completed_at")
    )
    return days.distinct().select(
        "id",
        "completed_at",
        F.col("completed_at").alias("started_at"),
        F.sha2("completed_at", 256).alias("snapshot_sha256"),
    )


def day_links(spark: SparkSession, sf: str) -> DataFrame:
    """One link per event; operators fold repeated links themselves."""
    return table(spark, sf, "events").select(_day().alias("snapshot_id"), F.col("user_id").alias("server_version_id"))


# --- yearly snapshots of shipped parts -----------------------------------------------------

SQL["year_links"] = """
SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS snapshot_id, l_partkey AS server_version_id FROM lineitem"""
SQL["year_snapshots"] = """
SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS id,
       CAST(year(l_shipdate) AS VARCHAR) || '-12-31T00:00:00Z' AS completed_at,
       sha256(CAST(year(l_shipdate) AS VARCHAR)) AS snapshot_sha256 FROM lineitem"""


def year_links(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(F.year("l_shipdate").cast("bigint").alias("snapshot_id"), F.col("l_partkey").alias("server_version_id"))
        .distinct()
    )


def year_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("id")).distinct()
    year = text_of(F.col("id"))
    return years.select(
        "id",
        F.concat(year, F.lit("-12-31T00:00:00Z")).alias("completed_at"),
        F.sha2(year, 256).alias("snapshot_sha256"),
    )


# --- catalog -------------------------------------------------------------------------------

SQL["versions"] = """
SELECT p_partkey AS id, p_name AS server_identifier, p_brand AS server_version,
  p_type || ' size ' || CAST(p_size AS VARCHAR) AS description, lower(p_type) AS registry_status,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE printf('2023-%02d-%02dT00:00:00Z', 1 + p_size % 12, 1 + p_partkey % 28) END AS published_at,
  CASE WHEN p_size % 3 = 0 THEN printf('2024-%02d-%02dT00:00:00Z', 1 + p_size % 12, 1 + p_partkey % 28) ELSE NULL END AS updated_at,
  sha256(p_name || '@' || p_brand || '#' || p_type) AS canonical_sha256
FROM part"""
SQL["packages"] = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS id,
  l_partkey AS server_version_id, l_linenumber AS position,
  CASE l_returnflag WHEN 'A' THEN 'npm' ELSE 'pypi' END AS registry_type,
  'pkg-' || CAST(l_suppkey AS VARCHAR) AS identifier,
  CASE WHEN l_discount >= 0.09 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0' END AS version,
  CASE l_linestatus WHEN 'F' THEN 'stdio' ELSE 'streamable-http' END AS transport
FROM lineitem WHERE l_returnflag <> 'R'"""
SQL["environment"] = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS package_id,
  0 AS position, 'ENV_' || CAST(l_suppkey AS VARCHAR) AS name
FROM lineitem WHERE l_returnflag <> 'R' AND l_tax >= 0.06"""
SQL["remotes"] = """
SELECT l_partkey AS server_version_id, l_linenumber AS position,
  'https://S' || CAST(l_suppkey % 10 AS VARCHAR) || '.Example.com/mcp/' || CAST(l_suppkey AS VARCHAR) AS url,
  's' || CAST(l_suppkey % 10 AS VARCHAR) || '.example.com' AS host,
  CASE l_linestatus WHEN 'F' THEN 'sse' ELSE 'streamable-http' END AS transport
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40"""
SQL["repositories"] = """
SELECT p_partkey AS server_version_id, 'git' AS source,
  'https://' || h || '/o' || CAST(p_size AS VARCHAR) || '/r' || CAST(p_partkey AS VARCHAR) AS url, h AS host
FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'github.com' ELSE 'gitlab.com' END AS h FROM part WHERE p_retailprice < 1200)"""


def _stamp(year: int) -> Column:
    return F.format_string(
        f"{year}-%02d-%02dT00:00:00Z", 1 + F.col("p_size") % 12, (1 + F.col("p_partkey") % 28).cast("int")
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("server_identifier"),
        F.col("p_brand").alias("server_version"),
        F.concat("p_type", F.lit(" size "), text_of(size)).alias("description"),
        F.lower("p_type").alias("registry_status"),
        F.when(size % 5 != 0, _stamp(2023)).alias("published_at"),
        F.when(size % 3 == 0, _stamp(2024)).alias("updated_at"),
        F.sha2(F.concat("p_name", F.lit("@"), "p_brand", F.lit("#"), "p_type"), 256).alias("canonical_sha256"),
    )


def _package_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")


def packages(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .filter("l_returnflag <> 'R'")
        .select(
            _package_id().alias("id"),
            F.col("l_partkey").alias("server_version_id"),
            F.col("l_linenumber").alias("position"),
            F.when(F.col("l_returnflag") == "A", "npm").otherwise("pypi").alias("registry_type"),
            F.concat(F.lit("pkg-"), text_of(F.col("l_suppkey"))).alias("identifier"),
            F.when(F.col("l_discount") < 0.09, F.concat(text_of(F.col("l_quantity").cast("int")), F.lit(".0"))).alias("version"),
            F.when(F.col("l_linestatus") == "F", "stdio").otherwise("streamable-http").alias("transport"),
        )
    )


def environment(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .filter("l_returnflag <> 'R' AND l_tax >= 0.06")
        .select(
            _package_id().alias("package_id"),
            F.lit(0).alias("position"),
            F.concat(F.lit("ENV_"), text_of(F.col("l_suppkey"))).alias("name"),
        )
    )


def remotes(spark: SparkSession, sf: str) -> DataFrame:
    digit = text_of(F.col("l_suppkey") % 10)
    return (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R' AND l_quantity >= 40")
        .select(
            F.col("l_partkey").alias("server_version_id"),
            F.col("l_linenumber").alias("position"),
            F.concat(F.lit("https://S"), digit, F.lit(".Example.com/mcp/"), text_of(F.col("l_suppkey"))).alias("url"),
            F.concat(F.lit("s"), digit, F.lit(".example.com")).alias("host"),
            F.when(F.col("l_linestatus") == "F", "sse").otherwise("streamable-http").alias("transport"),
        )
    )


def repositories(spark: SparkSession, sf: str) -> DataFrame:
    host = F.when(F.col("p_size") % 4 == 0, "github.com").otherwise("gitlab.com")
    return (
        table(spark, sf, "part")
        .filter("p_retailprice < 1200")
        .select(
            F.col("p_partkey").alias("server_version_id"),
            F.lit("git").alias("source"),
            F.concat(F.lit("https://"), host, F.lit("/o"), text_of(F.col("p_size")), F.lit("/r"), text_of(F.col("p_partkey"))).alias("url"),
            host.alias("host"),
        )
    )


def catalog(spark: SparkSession, sf: str) -> Catalog:
    return Catalog(
        year_snapshots(spark, sf),
        versions(spark, sf),
        year_links(spark, sf),
        repositories(spark, sf),
        packages(spark, sf),
        remotes(spark, sf),
        environment(spark, sf),
    )


CATALOG_VIEWS = ("year_snapshots", "year_links", "versions", "repositories", "packages", "remotes", "environment")

# --- observations: one per user and day, one tool per event type ---------------------------

SQL["tools"] = """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS target_id, strftime(ts, '%Y-%m-%dT00:00:00Z') AS observed_at,
       event_type AS name, max(props) AS definition, min(event_id) AS first_event
FROM events GROUP BY 1, 2, 3"""
SQL["observations"] = """
SELECT target_id, observed_at, count(*) AS n_tools, min(first_event) AS seq, min(name) AS executable
FROM tools GROUP BY 1, 2"""
USES["observations"] = ("tools",)
SQL["ranked"] = """
SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at DESC, seq DESC) AS rank FROM observations"""
USES["ranked"] = ("observations",)


def tools(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("user-"), text_of(F.col("user_id"))).alias("target_id"),
            F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("observed_at"),
            F.col("event_type").alias("name"),
        )
        .agg(F.max("props").alias("definition"), F.min("event_id").alias("first_event"))
    )


def observations(tool_rows: DataFrame) -> DataFrame:
    return tool_rows.groupBy("target_id", "observed_at").agg(
        F.count(F.lit(1)).alias("n_tools"),
        F.min("first_event").alias("seq"),
        F.min("name").alias("executable"),
    )


# --- queue, runs, findings -----------------------------------------------------------------

SQL["queue"] = """
SELECT 'profile-' || substr(o_orderpriority, 3) AS profile_key, o_orderkey AS package_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_totalprice < 60000 THEN 'unsupported' ELSE 'eligible' END
    ELSE CASE WHEN o_totalprice < 60000 THEN 'running' ELSE 'failed' END END AS state,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS attempt_count,
  CASE o_orderstatus WHEN 'F' THEN o_custkey END AS analysis_run_id,
  CASE o_orderstatus WHEN 'F' THEN sha256(CAST(o_custkey AS VARCHAR)) END AS artifact_sha256,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS discovered_at,
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS last_attempt_at,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM orders"""
SQL["runs"] = """
SELECT c_custkey AS id, c_nationkey AS package_id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status,
  c_mktsegment AS ruleset_version, 'archive' AS analysis_type, 'scan' AS analyzer_name,
  CASE WHEN c_nationkey < 12 THEN '1' ELSE '2' END AS analyzer_version,
  sha256(CAST(c_custkey AS VARCHAR)) AS artifact_sha256, printf('2024-01-%02dT00:00:00Z', 1 + c_custkey % 28) AS started_at
FROM customer"""
SQL["findings"] = """
SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS analysis_run_id, l_returnflag || l_linestatus AS rule_id,
  'cat-' || l_returnflag AS category, 'title ' || l_linestatus AS title, 'why' AS explanation,
  CASE WHEN l_quantity < 10 THEN 'info' WHEN l_quantity < 20 THEN 'low' WHEN l_quantity < 30 THEN 'medium'
       WHEN l_quantity < 40 THEN 'high' ELSE 'critical' END AS severity,
  CASE l_linenumber WHEN 1 THEN 'unreviewed' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'confirmed-risk' WHEN 4 THEN 'expected'
       ELSE 'unreviewed' END AS disposition,
  l_partkey
FROM lineitem"""
SQL["files"] = """
SELECT doc_id % 50 AS analysis_run_id, CAST(strlen(text) AS BIGINT) AS byte_size, n_chars > 2000 AS executable,
  source = 'src0' AS native_binary, lang = 'en' AS generated,
  (strlen(text) > 4096 AND length(text) - length(replace(text, chr(10), '')) < 3) AS minified
FROM documents"""
SQL["dependencies"] = "SELECT s_suppkey AS analysis_run_id, s_name AS dependency_name FROM supplier"


def queue(spark: SparkSession, sf: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    when = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    done = status == "F"
    return table(spark, sf, "orders").select(
        F.concat(F.lit("profile-"), F.substring("o_orderpriority", F.lit(3), F.lit(64))).alias("profile_key"),
        F.col("o_orderkey").alias("package_id"),
        F.when(done, "completed")
        .when(status == "O", F.when(price < 60000, "unsupported").otherwise("eligible"))
        .otherwise(F.when(price < 60000, "running").otherwise("failed"))
        .alias("state"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("attempt_count"),
        F.when(done, F.col("o_custkey")).alias("analysis_run_id"),
        F.when(done, F.sha2(text_of(F.col("o_custkey")), 256)).alias("artifact_sha256"),
        when.alias("discovered_at"),
        F.when(F.substring("o_orderpriority", 1, 1) != "1", when).alias("last_attempt_at"),
        when.alias("updated_at"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs_of(table(spark, sf, "customer"))


def runs_of(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("package_id"),
        F.when(F.col("c_acctbal") < 0, "failed").otherwise("completed").alias("status"),
        F.col("c_mktsegment").alias("ruleset_version"),
        F.lit("archive").alias("analysis_type"),
        F.lit("scan").alias("analyzer_name"),
        F.when(F.col("c_nationkey") < 12, "1").otherwise("2").alias("analyzer_version"),
        F.sha2(text_of(F.col("c_custkey")), 256).alias("artifact_sha256"),
        F.format_string("2024-01-%02dT00:00:00Z", (1 + F.col("c_custkey") % 28).cast("int")).alias("started_at"),
    )


def findings_of(lineitem: DataFrame) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return lineitem.select(
        (F.col("l_orderkey") * 8 + n).alias("id"),
        F.col("l_suppkey").alias("analysis_run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("rule_id"),
        F.concat(F.lit("cat-"), "l_returnflag").alias("category"),
        F.concat(F.lit("title "), "l_linestatus").alias("title"),
        F.lit("why").alias("explanation"),
        F.when(q < 10, "info").when(q < 20, "low").when(q < 30, "medium").when(q < 40, "high").otherwise("critical").alias("severity"),
        F.when(n == 2, "suspicious").when(n == 3, "confirmed-risk").when(n == 4, "expected").otherwise("unreviewed").alias("disposition"),
        "l_partkey",
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings_of(table(spark, sf, "lineitem"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(table(spark, sf, "documents"))


def files_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        (F.col("doc_id") % 50).alias("analysis_run_id"),
        F.octet_length("text").cast("bigint").alias("byte_size"),
        (F.col("n_chars") > 2000).alias("executable"),
        (F.col("source") == "src0").alias("native_binary"),
        (F.col("lang") == "en").alias("generated"),
        looks_minified("text").alias("minified"),
    )


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies_of(table(spark, sf, "supplier"))


def dependencies_of(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("analysis_run_id"), F.col("s_name").alias("dependency_name")
    )

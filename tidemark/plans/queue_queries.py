"""Summary, coverage, queue, review and publication queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import SEVERITIES
from ..operators import fingerprints, reviews, summaries, workqueue
from ..schemas import READ_MODEL
from ..session import scratch
from ..sinks import keyed, publish
from . import views as v
from .views import ORACLES, query, table, with_views

NOW = "2000-06-01 00:00:00"
PROFILE = {"analysis_type": "archive", "analyzer_name": "scan", "analyzer_version": "1", "ruleset_version": "BUILDING"}


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


# --- run and rule summaries ------------------------------------------------------------------

_FINDING_SQL = ", ".join(
    [f"{_count('TRUE')} AS finding_count"]
    + [f"""{_count(f"severity = '{s}'")} AS {s}_count""" for s in SEVERITIES]
    + [
        f"""{_count("disposition = 'unreviewed'")} AS unreviewed_count""",
        f"""{_count("disposition = 'unreviewed' AND severity = 'high'")} AS unreviewed_high_count""",
        f"""{_count("disposition = 'unreviewed' AND severity = 'critical'")} AS unreviewed_critical_count""",
        f"""{_count("disposition = 'suspicious'")} AS suspicious_count""",
        f"""{_count("disposition = 'confirmed-risk'")} AS confirmed_risk_count""",
    ]
)
_FINDING_NAMES = summaries.FINDING_COUNTERS
_BY_RUN = f"SELECT analysis_run_id, {_FINDING_SQL} FROM findings GROUP BY 1"
_FILES_BY_RUN = f"""SELECT analysis_run_id, count(*) AS file_count, CAST(sum(byte_size) AS BIGINT) AS total_file_bytes, {_count('executable')} AS executable_count,
{_count('native_binary')} AS native_binary_count, {_count('generated')} AS generated_count, {_count('minified')} AS minified_count FROM files GROUP BY 1"""
_SUMMARY_SQL = f"""SELECT r.id AS analysis_run_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in summaries.COUNTERS)} FROM runs r
LEFT JOIN by_run b ON b.analysis_run_id = r.id LEFT JOIN files_by_run f ON f.analysis_run_id = r.id
LEFT JOIN (SELECT analysis_run_id, count(*) AS dependency_count FROM dependencies GROUP BY 1) d ON d.analysis_run_id = r.id"""
_SUMMARY = {"by_run": _BY_RUN, "files_by_run": _FILES_BY_RUN, "summaries": _SUMMARY_SQL}
_SUMMARY_VIEWS = ("runs", "findings", "files", "dependencies")


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    runs = v.runs(spark, sf).select("id")
    return summaries.run_summaries(runs, v.findings(spark, sf), v.files(spark, sf), v.dependencies(spark, sf))


@query("a7_i10_run_summaries", with_views("SELECT * FROM summaries", *_SUMMARY_VIEWS, **_SUMMARY))
def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf)


@query(
    "a8_rule_definitions",
    with_views(
        """SELECT DISTINCT c_mktsegment || '/' || severity AS ruleset_version, rule_id, category, severity, title, explanation
        FROM findings JOIN customer ON c_custkey = analysis_run_id""",
        "findings",
    ),
)
def rule_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Rulesets per segment and severity, so that metadata is constant inside each."""
    found = v.findings(spark, sf).withColumn("analysis_run_id", F.concat_ws("/", "analysis_run_id", "severity"))
    levels = F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity")
    runs = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", levels).select(
        F.concat_ws("/", "c_custkey", "severity").alias("id"), F.concat_ws("/", "c_mktsegment", "severity").alias("ruleset_version")
    )
    return summaries.rule_definitions(found, runs)


@query(
    "a9_rule_occurrences",
    with_views("SELECT analysis_run_id, rule_id, count(*) AS occurrence_count FROM findings GROUP BY 1, 2", "findings"),
)
def rule_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.rule_occurrences(v.findings(spark, sf))


_QUEUE_SQL = f"""{_count("state IN ('eligible', 'running', 'completed', 'failed')")} AS eligible_package_records,
{_count("state = 'completed'")} AS completed_package_records, {_count("state = 'failed'")} AS failed_package_records,
{_count("state = 'unsupported'")} AS unsupported_package_records, {_count("state = 'unresolvable'")} AS unresolvable_package_records,
{_count("state = 'eligible' AND attempt_count = 0")} AS never_attempted_package_records, {_count("state = 'running'")} AS running_package_records,
count(DISTINCT CASE WHEN state = 'completed' THEN artifact_sha256 END) AS unique_artifacts_analyzed"""


def _totals(where: str) -> str:
    def total(expression: str, name: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {where} THEN {expression} END), 0) AS BIGINT) AS {name}"

    return ", ".join(
        [total(f"{s}_count", f"{s}_findings") for s in SEVERITIES]
        + [
            total("unreviewed_count", "unreviewed_findings"),
            total("unreviewed_high_count + unreviewed_critical_count", "unreviewed_high_or_critical_findings"),
            total("suspicious_count", "suspicious_findings"),
            total("confirmed_risk_count", "confirmed_risk_findings"),
        ]
    )


@query(
    "a10_j16_coverage_by_package",
    with_views(
        f"""SELECT q.profile_key, {_QUEUE_SQL}, {_totals("q.state = 'completed'")} FROM queue q
        LEFT JOIN summaries s ON s.analysis_run_id = q.analysis_run_id GROUP BY 1""",
        "queue",
        *_SUMMARY_VIEWS,
        **_SUMMARY,
    ),
)
def coverage_by_package(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.coverage_by_package(v.queue(spark, sf), _summaries(spark, sf))


@query(
    "a11_j17_coverage_by_run",
    with_views(
        f"""SELECT * FROM (SELECT profile_key, {_QUEUE_SQL} FROM queue GROUP BY 1) p JOIN
        (SELECT profile_key, {_totals("TRUE")}, count(*) AS distinct_completed_runs FROM summaries s
         JOIN (SELECT DISTINCT profile_key, analysis_run_id FROM queue WHERE state = 'completed') u ON u.analysis_run_id = s.analysis_run_id GROUP BY 1)
        USING (profile_key)""",
        "queue",
        *_SUMMARY_VIEWS,
        **_SUMMARY,
    ),
)
def coverage_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.coverage_by_run(v.queue(spark, sf), _summaries(spark, sf))


@query(
    "j25_t10_missing_summaries",
    with_views(
        """SELECT id FROM runs WHERE id NOT IN (SELECT analysis_run_id FROM findings) ORDER BY id LIMIT 1000""",
        "runs",
        "findings",
    ),
)
def missing_summaries(spark: SparkSession, sf: str) -> DataFrame:
    done = v.findings(spark, sf).select("analysis_run_id").distinct()
    return summaries.missing_summaries(v.runs(spark, sf), done, 1000).select("id")


@query(
    "i5_disposition_deltas",
    with_views(
        f"""SELECT analysis_run_id, {", ".join(f"n.{c} - o.{c} AS {c}" for c in _FINDING_NAMES if c.startswith(("unreviewed", "suspicious", "confirmed")))}
        FROM (SELECT analysis_run_id, {_FINDING_SQL} FROM changes GROUP BY 1) o
        JOIN (SELECT analysis_run_id, {_FINDING_SQL.replace("disposition", "new_disposition")} FROM changes GROUP BY 1) n USING (analysis_run_id)""",
        "findings",
        changes="""SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'suspicious' ELSE 'mitigated' END AS new_disposition FROM findings
          WHERE disposition <> CASE WHEN l_partkey % 2 = 0 THEN 'suspicious' ELSE 'mitigated' END""",
    ),
)
def disposition_deltas(spark: SparkSession, sf: str) -> DataFrame:
    changes = v.findings(spark, sf).select(
        "analysis_run_id",
        "severity",
        F.col("disposition").alias("old_disposition"),
        F.when(F.col("l_partkey") % 2 == 0, "suspicious").otherwise("mitigated").alias("new_disposition"),
    )
    return summaries.disposition_deltas(changes)


@query(
    "i5_summaries_after_review",
    with_views(
        f"""SELECT r.id AS analysis_run_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _FINDING_NAMES)} FROM runs r LEFT JOIN
        (SELECT analysis_run_id, {_FINDING_SQL} FROM reviewed GROUP BY 1) b ON b.analysis_run_id = r.id""",
        "runs",
        "findings",
        reviewed="""SELECT analysis_run_id, severity, CASE WHEN l_partkey % 2 = 0 THEN 'suspicious' ELSE 'mitigated' END AS disposition FROM findings""",
    ),
)
def summaries_after_review(spark: SparkSession, sf: str) -> DataFrame:
    """Stored counters plus signed deltas equal a recount after the change."""
    rows = summaries.run_summaries(v.runs(spark, sf).select("id"), v.findings(spark, sf))
    after = summaries.apply_deltas(rows, disposition_deltas(spark, sf))
    return after.select("analysis_run_id", *_FINDING_NAMES)


# --- queue -----------------------------------------------------------------------------------


@query(
    "a12_static_queue_summary",
    with_views(
        f"""SELECT profile_key, count(*) AS total_package_records, {_count("state IN ('eligible', 'running', 'completed', 'failed')")} AS eligible_package_records,
        {_count("state = 'completed'")} AS successfully_analyzed, {_count("state = 'failed'")} AS failed_attempts,
        {_count("state IN ('unsupported', 'unresolvable')")} AS unsupported_or_unresolvable, {_count("state = 'eligible' AND attempt_count = 0")} AS never_attempted,
        count(DISTINCT CASE WHEN state = 'completed' THEN artifact_sha256 END) AS unique_artifacts_analyzed, {_count("state = 'running'")} AS running FROM queue GROUP BY 1""",
        "queue",
    ),
)
def static_queue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.static_queue_summary(v.queue(spark, sf))


_RUNTIME = """SELECT *, CASE WHEN package_id % 3 = 0 THEN package_id END AS previous_compatible_run_id, CASE WHEN package_id % 6 = 0 THEN 1 END AS added_tools FROM queue"""


@query(
    "a13_runtime_queue_summary",
    with_views(
        f"""SELECT profile_key, count(*) AS total_package_records, {_count("state IN ('eligible', 'running', 'completed', 'failed')")} AS eligible_package_records,
        {_count("state = 'completed'")} AS completed_observations, {_count("state = 'failed'")} AS failed_attempts,
        {_count("state IN ('unsupported', 'unresolvable')")} AS unsupported_or_unresolvable, {_count("state = 'eligible' AND attempt_count = 0")} AS never_attempted,
        count(DISTINCT CASE WHEN state = 'completed' THEN artifact_sha256 END) AS unique_artifacts_observed, {_count("state = 'running'")} AS running,
        {_count("state = 'completed' AND previous_compatible_run_id IS NOT NULL")} AS comparable_observations,
        {_count("state = 'completed' AND previous_compatible_run_id IS NOT NULL AND added_tools > 0")} AS drifted_observations FROM runtime GROUP BY 1""",
        "queue",
        runtime=_RUNTIME,
    ),
)
def runtime_queue_summary(spark: SparkSession, sf: str) -> DataFrame:
    key, none = F.col("package_id"), F.lit(None).cast("int")
    rows = v.queue(spark, sf).select(
        "*",
        F.when(key % 3 == 0, key).alias("previous_compatible_run_id"),
        F.when(key % 6 == 0, 1).alias("added_tools"),
        none.alias("removed_tools"),
        none.alias("modified_tools"),
    )
    return summaries.runtime_queue_summary(rows)


@query(
    "a14_remaining_queue",
    with_views(
        f"""SELECT profile_key, {_count("state IN ('eligible', 'failed', 'running') AND attempt_count < 3")} AS remaining FROM queue GROUP BY 1""", "queue"
    ),
)
def remaining_queue(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.remaining_queue(v.queue(spark, sf), 3)


KEY = "profile-second"
_TWO = f"(SELECT * FROM queue UNION ALL SELECT * REPLACE ('{KEY}' AS profile_key) FROM queue)"


def two_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The queue, and every package once more under a second profile."""
    queue = v.queue(spark, sf)
    return queue.unionByName(queue.withColumn("profile_key", F.lit(KEY)))


@query(
    "t5_drill_downs",
    with_views(
        f"""(SELECT 'completed' AS kind, package_id FROM {_TWO} WHERE profile_key = '{KEY}' AND state = 'completed' ORDER BY updated_at DESC, package_id DESC LIMIT 50)
        UNION ALL (SELECT 'never_attempted', package_id FROM {_TWO} WHERE profile_key = '{KEY}' AND state = 'eligible' AND attempt_count = 0 ORDER BY updated_at DESC, package_id DESC LIMIT 50)
        UNION ALL (SELECT 'eligible', package_id FROM {_TWO} WHERE profile_key = '{KEY}' AND state IN ('eligible', 'running', 'completed', 'failed') ORDER BY updated_at DESC, package_id DESC LIMIT 50)""",
        "queue",
    ),
)
def drill_downs(spark: SparkSession, sf: str) -> DataFrame:
    queue = two_profiles(spark, sf)
    parts = [
        workqueue.drill_down(queue, kind, KEY).select(F.lit(kind).alias("kind"), "package_id")
        for kind in ("completed", "never_attempted", "eligible")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "t7_j18_candidates",
    with_views(
        f"""SELECT q.package_id, p_name AS server_identifier, p_brand AS server_version, 'pkg-' || CAST(q.package_id AS VARCHAR) AS package_identifier
        FROM {_TWO} q JOIN orders ON o_orderkey = q.package_id JOIN part ON p_partkey = o_custkey
        WHERE profile_key = '{KEY}' AND state IN ('eligible', 'failed') AND attempt_count < 4
          AND (last_attempt_at IS NULL OR CAST(last_attempt_at AS TIMESTAMP) <= TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND)
        ORDER BY discovered_at DESC, CASE state WHEN 'eligible' THEN 0 ELSE 1 END, attempt_count, q.package_id DESC LIMIT 250""",
        "queue",
    ),
)
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    packages = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("server_version_id"),
        F.concat(F.lit("pkg-"), F.col("o_orderkey").cast("string")).alias("identifier"),
    )
    return workqueue.candidates(two_profiles(spark, sf), packages, v.versions(spark, sf), KEY, NOW, 4, 3600, 250)


_ALL_RUNS = """SELECT o_orderkey AS id, o_custkey AS package_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN o_totalprice < 200000 THEN '1' ELSE '2' END AS analyzer_version, sha256(CAST(o_orderkey AS VARCHAR)) AS artifact_sha256 FROM orders"""


def _all_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("package_id"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.lit("archive").alias("analysis_type"),
        F.lit("scan").alias("analyzer_name"),
        F.when(F.col("o_totalprice") < 200000, "1").otherwise("2").alias("analyzer_version"),
        F.lit("BUILDING").alias("ruleset_version"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("artifact_sha256"),
    )


@query(
    "w7_j15_compatible_runs",
    f"""WITH r AS ({_ALL_RUNS}) SELECT package_id, max(id) AS run_id, arg_max(artifact_sha256, id) AS run_artifact FROM r
    WHERE status = 'completed' AND analyzer_version = '1' GROUP BY 1""",
)
def compatible_runs(spark: SparkSession, sf: str) -> DataFrame:
    return workqueue.compatible_runs(_all_runs(spark, sf), PROFILE)


_STATE = """SELECT 'key' AS profile_key, c_custkey AS package_id, CASE c_nationkey % 5 WHEN 0 THEN 'eligible' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed'
ELSE 'unsupported' END AS state, CASE WHEN c_nationkey % 5 = 2 THEN 'analysis_failed' END AS reason_code, CAST(c_nationkey AS INTEGER) AS attempt_count,
CASE WHEN c_nationkey % 5 = 3 THEN c_custkey END AS analysis_run_id,
CASE WHEN c_nationkey % 2 = 0 THEN '2024-01-01 00:00:00' ELSE '2024-01-02 12:00:00' END AS last_attempt_at FROM customer WHERE c_acctbal >= 0"""
_PKG = "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'oci' ELSE 'npm' END AS registry_type FROM customer"
_SYNC_NOW = "2024-01-03 00:00:00"


def _sync_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf, "customer")
    packages = customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "oci").otherwise("npm").alias("registry_type"),
        F.col("c_name").alias("identifier"),
        F.lit("1").alias("version"),
    )
    kind = F.col("c_nationkey") % 5
    state = F.when(kind == 0, "eligible").when(kind == 1, "running").when(kind == 2, "failed").when(kind == 3, "completed").otherwise("unsupported")
    none = F.lit(None).cast("string")
    queue = customer.filter("c_acctbal >= 0").select(
        F.lit("key").alias("profile_key"),
        F.col("c_custkey").alias("package_id"),
        state.alias("state"),
        F.when(kind == 2, "analysis_failed").alias("reason_code"),
        none.alias("reason_message"),
        F.col("c_nationkey").alias("attempt_count"),
        F.when(kind == 3, F.col("c_custkey")).alias("analysis_run_id"),
        none.alias("artifact_sha256"),
        F.lit(False).alias("reused_existing"),
        F.lit("2023-12-31 00:00:00").alias("discovered_at"),
        F.when(F.col("c_nationkey") % 2 == 0, "2024-01-01 00:00:00").otherwise("2024-01-02 12:00:00").alias("last_attempt_at"),
        F.lit("2024-01-01 00:00:00").alias("updated_at"),
    )
    return packages, queue


@query(
    "i7_i9_synchronized_queue",
    f"""WITH r AS ({_ALL_RUNS}), s AS ({_STATE}), p AS ({_PKG}),
    done AS (SELECT package_id, max(id) AS run_id FROM r WHERE status = 'completed' AND analyzer_version = '1' GROUP BY 1),
    j AS (SELECT p.id AS package_id, p.registry_type, s.*, s.package_id IS NOT NULL AS known, d.run_id FROM p LEFT JOIN s ON s.package_id = p.id LEFT JOIN done d ON d.package_id = p.id),
    n AS (SELECT *, CASE WHEN run_id IS NOT NULL THEN 'completed' WHEN registry_type = 'oci' THEN 'unsupported'
        WHEN known AND state IN ('failed', 'running') THEN state ELSE 'eligible' END AS next FROM j),
    z AS (SELECT *, next = 'running' AND last_attempt_at <= '2024-01-02 00:00:00' AS stale FROM n)
    SELECT package_id, CASE WHEN stale THEN 'failed' ELSE next END AS state,
      CASE WHEN stale THEN 'interrupted' WHEN next = 'unsupported' THEN 'unsupported_registry' WHEN next = 'failed' THEN reason_code END AS reason_code,
      coalesce(attempt_count, 0) AS attempt_count, CASE WHEN next = 'completed' THEN run_id END AS analysis_run_id FROM z""",
)
def synchronized_queue(spark: SparkSession, sf: str) -> DataFrame:
    packages, queue = _sync_inputs(spark, sf)
    rows = workqueue.synchronize_static(packages, queue, _all_runs(spark, sf), PROFILE, "key", _SYNC_NOW, 86400)
    return rows.select("package_id", "state", "reason_code", "attempt_count", "analysis_run_id")


_PROFILES = """SELECT c_mktsegment AS profile_key, min(c_name) AS analyzer_name, '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS selected_at FROM customer GROUP BY 1"""


@query(
    "i9_registered_profiles",
    f"""SELECT profile_key, analyzer_name, created_at, CASE WHEN profile_key = 'BUILDING' THEN '{NOW}' ELSE selected_at END AS selected_at FROM ({_PROFILES})
    UNION ALL SELECT 'ADDED', 'later', '{NOW}', '{NOW}'""",
)
def registered_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One known profile selected again, and one new one."""
    start = F.lit("2024-01-01 00:00:00")
    known = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("profile_key")).agg(F.min("c_name").alias("analyzer_name"))
    known = known.withColumn("created_at", start).withColumn("selected_at", start)
    renewed = workqueue.register_profile(known, "BUILDING", {"analyzer_name": "ignored"}, NOW)
    return workqueue.register_profile(renewed, "ADDED", {"analyzer_name": "later"}, NOW).select(known.columns)


@query(
    "i7_synchronized_runtime_queue",
    """WITH s AS (SELECT c_custkey AS package_id, c_nationkey % 5 AS kind, c_nationkey % 2 = 0 AS early, c_acctbal >= 5000 AS valid, c_mktsegment = 'MACHINERY' AS oci,
      c_acctbal >= 0 AS known, c_nationkey FROM customer),
    n AS (SELECT *, CASE WHEN NOT known THEN CASE WHEN oci THEN 'unsupported' ELSE 'eligible' END
      WHEN kind = 3 AND valid THEN 'completed' WHEN oci THEN 'unsupported' WHEN kind = 1 THEN 'running' WHEN kind = 2 THEN 'failed' ELSE 'eligible' END AS next FROM s)
    SELECT package_id, CASE WHEN next = 'running' AND early THEN 'failed' ELSE next END AS state,
      CASE WHEN next = 'running' AND early THEN 'interrupted' WHEN next = 'unsupported' THEN 'unsupported_ecosystem' WHEN next = 'failed' THEN 'analysis_failed' END AS reason_code,
      CASE WHEN next = 'completed' THEN package_id WHEN known AND kind = 3 THEN NULL END AS run_id FROM n""",
)
def synchronized_runtime_queue(spark: SparkSession, sf: str) -> DataFrame:
    packages, queue = _sync_inputs(spark, sf)
    none = F.lit(None).cast("int")
    queue = queue.drop("reused_existing").withColumnRenamed("analysis_run_id", "runtime_observation_run_id").select(
        "*",
        F.lit("lp").alias("launch_profile_sha256"),
        F.lit(None).cast("bigint").alias("previous_compatible_run_id"),
        *[none.alias(f"{c}_tools") for c in ("added", "removed", "modified", "unchanged")],
    )
    runs = table(spark, sf, "customer").filter("c_acctbal >= 5000").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("package_id"), F.lit("completed").alias("status"), F.lit("sha256:g").alias("guard_version"),
        F.lit("image").alias("sandbox_image"), F.lit("a").alias("artifact_sha256"), F.lit("lp").alias("launch_profile_sha256"),
    )
    packages = packages.withColumn("transport", F.lit("stdio"))
    profile = {"guard_sha256": "g", "runtime_image": "image"}
    rows = workqueue.synchronize_runtime(packages, queue, runs, profile, "key", _SYNC_NOW, 86400)
    return rows.select("package_id", "state", "reason_code", F.col("runtime_observation_run_id").alias("run_id"))


@query(
    "i8_applied_transitions",
    with_views(
        """SELECT q.package_id, CASE WHEN e.last_line % 2 = 0 THEN 'running' WHEN e.results > 0 THEN 'failed' ELSE q.state END AS state,
        CAST(q.attempt_count + coalesce(e.claims, 0) AS INTEGER) AS attempt_count FROM queue q LEFT JOIN
        (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS claims, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS results,
         max(l_linenumber) AS last_line FROM lineitem GROUP BY 1) e ON e.l_orderkey = q.package_id""",
        "queue",
    ),
)
def applied_transitions(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("package_id"), F.concat(F.lit("profile-"), F.substring("o_orderpriority", F.lit(3), F.lit(64))).alias("profile_key")
    )
    line = F.col("l_linenumber")
    events = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("package_id"),
        line.alias("seq"),
        F.when(line % 2 == 0, "claim").otherwise("result").alias("kind"),
        F.lit("2024-01-01 00:00:00").alias("at"),
        F.lit("failed").alias("state"),
        F.lit("analysis_failed").alias("reason_code"),
        F.lit("m").alias("reason_message"),
        F.lit(None).cast("bigint").alias("analysis_run_id"),
        F.lit(None).cast("string").alias("artifact_sha256"),
        F.lit(False).alias("reused_existing"),
    ).join(keys, "package_id")
    none = F.lit(None).cast("string")
    queue = v.queue(spark, sf).select("*", none.alias("reason_code"), none.alias("reason_message"), F.lit(False).alias("reused_existing"))
    return workqueue.apply_transitions(queue, events).select("package_id", "state", "attempt_count")


@query(
    "v29_verified_runs",
    with_views(
        """SELECT profile_key, q.package_id, q.analysis_run_id, r.id IS NOT NULL AS verified FROM queue q LEFT JOIN runs r ON r.id = q.analysis_run_id
        AND r.status = 'completed' AND r.analyzer_version = '1' AND r.ruleset_version = 'BUILDING' WHERE q.state = 'completed'""",
        "queue",
        "runs",
    ),
)
def verified_runs(spark: SparkSession, sf: str) -> DataFrame:
    return workqueue.verify_completed(v.queue(spark, sf), v.runs(spark, sf), PROFILE)


@query(
    "j10_resolved_packages",
    with_views(
        """SELECT q.server_identifier, q.server_version, q.package_identifier, CASE WHEN n IS NULL THEN 'package_not_found' WHEN kinds > 1 THEN 'ambiguous_package'
        WHEN coalesce(ver, '') = '' THEN 'missing_version' ELSE 'resolved' END AS status FROM requests q LEFT JOIN
        (SELECT server_identifier, server_version, identifier, count(*) AS n, count(DISTINCT (registry_type, coalesce(version, '-'))) AS kinds,
          min(version) AS ver FROM named GROUP BY 1, 2, 3) m
        ON m.server_identifier = q.server_identifier AND m.server_version = q.server_version AND m.identifier = q.package_identifier""",
        "versions",
        "packages",
        named="SELECT server_identifier, server_version, identifier, registry_type, version FROM packages JOIN versions ON versions.id = server_version_id",
        requests="""SELECT DISTINCT server_identifier, server_version, 'pkg-' || CAST(l_suppkey AS VARCHAR) AS package_identifier
          FROM lineitem JOIN versions ON id = l_partkey WHERE l_quantity >= 30""",
    ),
)
def resolved_packages(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).drop("package_id")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    versions = v.versions(spark, sf)
    requests = (
        table(spark, sf, "lineitem")
        .filter("l_quantity >= 30")
        .join(versions, F.col("l_partkey") == F.col("id"))
        .select("server_identifier", "server_version", F.concat(F.lit("pkg-"), F.col("l_suppkey").cast("string")).alias("package_identifier"))
        .distinct()
    )
    return workqueue.resolve_packages(requests, v.packages(spark, sf), versions)


@query(
    "j10_package_ids",
    with_views(
        """SELECT server_identifier, server_version, identifier AS package_identifier, arg_min(pid, (position, pid)) AS package_id FROM named
        WHERE (server_identifier, server_version, identifier) IN (SELECT (server_identifier, server_version, package_identifier) FROM requests)
        GROUP BY 1, 2, 3 HAVING count(DISTINCT (registry_type, coalesce(version, '-'))) = 1 AND coalesce(min(version), '') <> ''""",
        "versions",
        "packages",
        named="SELECT server_identifier, server_version, identifier, registry_type, version, position, p.id AS pid FROM packages p JOIN versions ON versions.id = server_version_id",
        requests="""SELECT DISTINCT server_identifier, server_version, 'pkg-' || CAST(l_suppkey AS VARCHAR) AS package_identifier
          FROM lineitem JOIN versions ON id = l_partkey WHERE l_quantity >= 30""",
    ),
)
def package_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The exact package of every request that has one."""
    return _resolved(spark, sf).filter("status = 'resolved'").drop("status")


# --- reviews ---------------------------------------------------------------------------------


@query(
    "t6_review_queue",
    with_views(
        """SELECT id, severity, analysis_run_id FROM findings WHERE disposition = 'unreviewed' AND severity IN ('high', 'critical')
        ORDER BY severity, analysis_run_id DESC, id DESC LIMIT 100 OFFSET 40""",
        "findings",
    ),
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.review_queue(v.findings(spark, sf), 100, 40).select("id", "severity", "analysis_run_id")




@query(
    "i6_judged_reviews",
    """WITH f AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 8 THEN 'unreviewed' WHEN c_nationkey < 16 THEN 'expected' ELSE 'mitigated' END AS current FROM customer WHERE c_acctbal > 0),
    q AS (SELECT o_orderkey AS seq, o_custkey AS finding_id, CASE o_orderstatus WHEN 'F' THEN 'expected' ELSE 'unreviewed' END AS expected,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 'nonsense' ELSE 'mitigated' END AS wanted FROM orders),
    j AS (SELECT q.*, f.current, coalesce(wanted <> 'nonsense' AND current = expected AND current <> wanted, FALSE) AS fits FROM q LEFT JOIN f ON f.id = q.finding_id),
    w AS (SELECT *, fits AND seq = min(CASE WHEN fits THEN seq END) OVER (PARTITION BY finding_id) AS won FROM j)
    SELECT seq, finding_id, CASE WHEN wanted = 'nonsense' THEN 'invalid' WHEN current IS NULL THEN 'not_found' WHEN won THEN 'accepted' ELSE 'conflict' END AS outcome FROM w""",
)
def judged_reviews(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("c_nationkey")
    current = F.when(nation < 8, "unreviewed").when(nation < 16, "expected").otherwise("mitigated")
    found = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), current.alias("disposition"))
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("finding_id"),
        F.when(F.col("o_orderstatus") == "F", "expected").otherwise("unreviewed").alias("expected_disposition"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "nonsense").otherwise("mitigated").alias("disposition"),
        F.lit("someone").alias("reviewer"),
    )
    return reviews.judge_reviews(requests, found).select("seq", "finding_id", "outcome")


@query(
    "i6_current_dispositions",
    """SELECT c_custkey AS id, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'unreviewed') AS disposition FROM customer""",
)
def current_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("unreviewed").alias("disposition"))
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("finding_id"), F.col("o_orderstatus").alias("disposition"))
    return reviews.current_dispositions(found, log)


# --- publication -----------------------------------------------------------------------------


@query(
    "k4_k5_published_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'published' ELSE o_orderpriority END AS o_orderpriority FROM orders
    WHERE o_orderstatus IN ('O', 'F')""",
)
def published_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A first generation, then one with replaced and new rows; readers see the newest."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    root = scratch(spark, "published")
    first = orders.filter("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    publish.publish_generation({"orders": first}, root, "g1")
    update = orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("published").alias("o_orderpriority"))
    merged = publish.upserted(publish.read_generation(spark, root, "orders"), update, ["o_orderkey"])
    publish.publish_generation({"orders": merged}, root, "g2")
    return publish.read_generation(spark, root, "orders")


@query("k4_k5_keyed_upsert", ORACLES["k4_k5_published_upsert"])
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same two generations as files by key range: only files with changed keys are written again."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    root, keys = scratch(spark, "keyed"), ["o_orderkey"]
    first = orders.filter("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    keyed.create(first, keys, root, "g1")
    keyed.upsert(orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("published").alias("o_orderpriority")), keys, root, "g2")
    return keyed.read(spark, root)


@query(
    "k6_a19_read_model",
    with_views(
        """SELECT 'analysis_runs' AS table_name, count(*) AS history, count(*) AS hot, TRUE AS equal FROM runs
        UNION ALL SELECT 'run_summaries', count(*), count(*), TRUE FROM runs UNION ALL SELECT 'analysis_findings', count(*), NULL, FALSE FROM findings""",
        "runs",
        "findings",
    ),
)
def read_model(spark: SparkSession, sf: str) -> DataFrame:
    """Summary tables are published, detail tables are not."""
    history = {
        "analysis_runs": v.runs(spark, sf),
        "run_summaries": summaries.run_summaries(v.runs(spark, sf).select("id"), v.findings(spark, sf)),
        "analysis_findings": v.findings(spark, sf),
    }
    root = scratch(spark, "hot")
    publish.publish_read_model(history, root, "g1")
    hot = {n: publish.read_generation(spark, root, n) for n in history if n in READ_MODEL}
    return summaries.verify_publication(history, hot)


_HOT_RUNS = """SELECT * REPLACE (CASE WHEN id = (SELECT max(id) FROM runs WHERE status = 'completed') THEN 'altered' ELSE ruleset_version END AS ruleset_version)
FROM runs WHERE id <> (SELECT min(id) FROM runs WHERE status = 'failed')"""


def _published_pair(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A history and a read model published from it, in which one row is altered and one is missing."""
    history = {"analysis_runs": v.runs(spark, sf), "run_summaries": _summaries(spark, sf), "analysis_findings": v.findings(spark, sf)}
    altered = history["analysis_runs"].filter("status = 'completed'").agg(F.max("id").alias("id")).scalar()
    missing = history["analysis_runs"].filter("status = 'failed'").agg(F.min("id").alias("id")).scalar()
    hot_runs = history["analysis_runs"].filter(F.col("id") != missing).withColumn(
        "ruleset_version", F.when(F.col("id") == altered, "altered").otherwise(F.col("ruleset_version"))
    )
    roots = scratch(spark, "history"), scratch(spark, "hot")
    publish.publish_generation(history, roots[0], "g1")
    publish.publish_read_model({**history, "analysis_runs": hot_runs}, roots[1], "g1")
    return roots


@query(
    "a19_row_equality",
    with_views(
        """SELECT 'analysis_runs' AS table_name, (SELECT count(*) FROM runs) AS history, (SELECT count(*) FROM hot_runs) AS hot, FALSE AS equal, FALSE AS same_rows
        UNION ALL SELECT 'run_summaries', count(*), count(*), TRUE, TRUE FROM summaries UNION ALL SELECT 'analysis_findings', count(*), NULL, FALSE, FALSE FROM findings""",
        *_SUMMARY_VIEWS,
        **_SUMMARY,
        hot_runs=_HOT_RUNS,
    ),
)
def row_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rows of a history against the read model published from it."""
    history, hot = _published_pair(spark, sf)
    names = ("analysis_runs", "run_summaries", "analysis_findings")
    stored = {n: publish.read_generation(spark, history, n) for n in names}
    return fingerprints.verify_rows(stored, {n: publish.read_generation(spark, hot, n) for n in names if n in READ_MODEL})


@query(
    "a19_located_rows",
    with_views(
        """SELECT *, 1::BIGINT AS left_copies, 0::BIGINT AS right_copies FROM (SELECT * FROM runs EXCEPT ALL SELECT * FROM hot_runs)
        UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM hot_runs EXCEPT ALL SELECT * FROM runs)""",
        "runs",
        hot_runs=_HOT_RUNS,
    ),
)
def located_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The altered and the missing row, found by way of the ranges whose fingerprints differ."""
    history, hot = _published_pair(spark, sf)
    return fingerprints.difference(publish.read_generation(spark, history, "analysis_runs"), publish.read_generation(spark, hot, "analysis_runs"), ["id"])


@query(
    "k9_evidence_manifests",
    with_views(
        """SELECT id AS analysis_run_id, 'bundle' AS storage_kind, 'sha256/' || artifact_sha256 AS locator, FALSE AS retained_artifact FROM runs
        WHERE status = 'completed' AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
        "runs",
    ),
)
def evidence_manifests(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.col("o_custkey").cast("string"), 256)
    bundles = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(digest.alias("artifact_sha256")).distinct()
    bundles = bundles.select(
        "artifact_sha256", F.concat(F.lit("sha256/"), "artifact_sha256").alias("locator"), F.lit("b").alias("bundle_sha256"), F.lit("i").alias("inventory_sha256")
    )
    rows = publish.evidence_manifests(v.runs(spark, sf), bundles)
    return rows.select("analysis_run_id", "storage_kind", "locator", "retained_artifact")

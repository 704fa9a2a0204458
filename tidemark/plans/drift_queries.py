"""Observation history and drift queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.documents import strict_inventory
from ..operators import drift, ordering
from ..session import scratch
from ..sinks import publish
from ..sources import lines
from . import views as v
from .views import query, table, with_views

_SIDES = {
    "newer": "SELECT t.* FROM tools t JOIN ranked r USING (target_id, observed_at) WHERE r.rank = 1",
    "older": "SELECT t.* FROM tools t JOIN ranked r USING (target_id, observed_at) WHERE r.rank = 2",
    "changes": """SELECT coalesce(n.target_id, o.target_id) AS target_id, coalesce(n.name, o.name) AS name,
      CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN n.definition = o.definition THEN 'unchanged' ELSE 'modified' END AS change
      FROM (SELECT * FROM newer WHERE target_id IN (SELECT target_id FROM older)) n
      FULL JOIN older o ON o.target_id = n.target_id AND o.name = n.name""",
    "counts": """SELECT target_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
      count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM changes GROUP BY 1""",
}


def _latest_changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tools = v.tools(spark, sf)
    two = drift.with_predecessor(drift.latest_two(v.observations(tools)))
    rows = tools.join(two.select("target_id", "observed_at", "rank"), ["target_id", "observed_at"])
    return two, rows, drift.compare_tools(rows, ["target_id"], F.col("rank") == 1)


@query("w3_latest_two", with_views("SELECT target_id, observed_at, n_tools, rank FROM ranked WHERE rank <= 2", "ranked"))
def latest_two(spark: SparkSession, sf: str) -> DataFrame:
    two = drift.latest_two(v.observations(v.tools(spark, sf)))
    return two.select("target_id", "observed_at", "n_tools", F.col("rank").cast("bigint").alias("rank"))


@query("j12_j13_tool_changes", with_views("SELECT * FROM changes", "ranked", **_SIDES))
def tool_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _latest_changes(spark, sf)[2]


@query(
    "a18_drift_counts",
    with_views("SELECT *, added + removed + modified > 0 AS drifted FROM counts", "ranked", **_SIDES),
)
def drift_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_counts(_latest_changes(spark, sf)[2], ["target_id"])


@query(
    "a21_drift_verdicts",
    with_views(
        """SELECT target_id, added, removed, modified, unchanged, b.executable <> a.executable AS executable_changed,
        CASE WHEN added + removed + modified > 0 OR b.executable <> a.executable THEN 'material_drift' ELSE 'identical' END AS verdict
        FROM counts JOIN (SELECT * FROM ranked WHERE rank = 1) a USING (target_id) JOIN (SELECT * FROM ranked WHERE rank = 2) b USING (target_id)""",
        "ranked",
        **_SIDES,
    ),
)
def drift_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    two, _, changes = _latest_changes(spark, sf)
    sides = (
        two.groupBy("target_id")
        .agg(
            F.max(F.when(F.col("rank") == 2, F.col("executable"))).alias("executable_before"),
            F.max(F.when(F.col("rank") == 1, F.col("executable"))).alias("executable_after"),
        )
        .filter("executable_before IS NOT NULL")
    )
    return drift.drift_verdict(drift.drift_counts(changes, ["target_id"]), sides, ["target_id"])


@query(
    "w9_consecutive_diffs",
    with_views(
        """SELECT coalesce(n.target_id, o.target_id) AS target_id, coalesce(n.observed_at, o.observed_at) AS observed_at, coalesce(n.name, o.name) AS name,
        CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN n.definition = o.definition THEN 'unchanged' ELSE 'modified' END AS change
        FROM newer n FULL JOIN older o ON o.target_id = n.target_id AND o.observed_at = n.observed_at AND o.name = n.name""",
        "observations",
        pairs="SELECT * FROM (SELECT target_id, lag(observed_at) OVER (PARTITION BY target_id ORDER BY observed_at) AS a, observed_at AS b FROM observations) WHERE a IS NOT NULL",
        newer="SELECT t.* FROM tools t JOIN pairs p ON p.target_id = t.target_id AND p.b = t.observed_at",
        older="SELECT t.target_id, p.b AS observed_at, t.name, t.definition FROM tools t JOIN pairs p ON p.target_id = t.target_id AND p.a = t.observed_at",
    ),
)
def consecutive_diffs(spark: SparkSession, sf: str) -> DataFrame:
    tools = v.tools(spark, sf)
    times = tools.select("target_id", "observed_at").distinct()
    return drift.consecutive_diffs(tools, times, "target_id", "observed_at", F.substring("observed_at", 1, 7))


@query(
    "a2_history_summary",
    with_views(
        """SELECT count(*) AS records, count(DISTINCT target_id) AS targets, min(observed_at) AS earliest_observed_at,
        max(observed_at) AS latest_observed_at FROM observations""",
        "observations",
    ),
)
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return drift.history_summary(v.observations(v.tools(spark, sf)))


@query(
    "u2_name_sets",
    with_views(
        """SELECT target_id, observed_at, list_sort(list_filter(names, lambda x: x NOT IN ('click', 'view'))) AS added,
        list_sort(list_filter(['click', 'view'], lambda x: NOT list_contains(names, x))) AS removed FROM sets""",
        "tools",
        sets="SELECT target_id, observed_at, list(name) AS names FROM tools GROUP BY 1, 2",
    ),
)
def name_sets(spark: SparkSession, sf: str) -> DataFrame:
    # An inventory is limited to 1,024 distinct names, so its name array is bounded.
    names = v.tools(spark, sf).groupBy("target_id", "observed_at").agg(F.collect_set("name").alias("names"))
    sets = drift.name_sets(F.array(F.lit("click"), F.lit("view")), F.col("names"))
    return names.select("target_id", "observed_at", sets["added"].alias("added"), sets["removed"].alias("removed"))


@query(
    "j11_previous_compatible_run",
    """WITH r AS (SELECT o_orderpriority AS profile_key, 'nation-' || CAST(c_nationkey AS VARCHAR) AS server_identifier, c_mktsegment AS package_identifier,
      o_custkey AS server_version_id, o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS recency FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT profile_key, server_identifier, package_identifier, server_version_id, run_id,
      (SELECT arg_max(q.run_id, (q.recency, q.run_id)) FROM r q WHERE q.profile_key = r.profile_key AND q.server_identifier = r.server_identifier
       AND q.package_identifier = r.package_identifier AND q.server_version_id <> r.server_version_id) AS previous_run_id FROM r""",
)
def previous_compatible_run(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    rows = table(spark, sf, "orders").join(customer, "o_custkey").select(
        F.col("o_orderpriority").alias("profile_key"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("server_identifier"),
        F.col("c_mktsegment").alias("package_identifier"),
        F.col("o_custkey").alias("server_version_id"),
        F.col("o_orderkey").alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("recency"),
    )
    return drift.previous_compatible_runs(rows)


# --- documents written from the tables, then scanned ---------------------------------------


def _observation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Nested observations; distinct tool names of one target and day are a bounded inventory."""
    tool = F.struct("name", "definition", F.concat(F.lit('{"name":"'), "name", F.lit('", "definition": '), "definition", F.lit("}")).alias("text"))
    rows = v.tools(spark, sf).groupBy("target_id", "observed_at").agg(
        F.array_sort(F.collect_list(tool)).alias("tools"), F.min("name").alias("executable")
    )
    texts = F.array_join(F.transform("tools", lambda t: t["text"]), ", ")
    inventory = F.concat(
        F.lit('{"inventory_version": 1, "server": {"downstream_executable": "'), "executable", F.lit('"}, "tools": ['), texts, F.lit("]}")
    )
    return rows.select(
        "target_id",
        "observed_at",
        F.lit("table").alias("source_type"),
        F.lit("sensor").alias("sensor_name"),
        F.lit("1").alias("sensor_version"),
        F.lit("default").alias("configuration_profile"),
        "executable",
        inventory.alias("inventory_json"),
    )


@query("s1_history_scan", with_views("SELECT * FROM changes", "ranked", **_SIDES))
def history_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "history")
    publish.append_observations(_observation_rows(spark, sf), path)
    return drift.latest_drift(lines.read_observations(spark, path))


@query(
    "v4_observation_rejects",
    with_views(
        """SELECT target_id, observed_at, n_tools >= 2 AS accepted FROM observations""",
        "observations",
    ),
)
def observation_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a single tool get an unsupported inventory version and must be rejected."""
    rows = _observation_rows(spark, sf)
    swapped = rows.withColumn(
        "inventory_json",
        F.when(
            F.col("inventory_json").rlike(r"\}, \{"), F.col("inventory_json")
        ).otherwise(F.regexp_replace("inventory_json", r'"inventory_version": 1', '"inventory_version": 2')),
    )
    keyed = swapped.select(publish.observation_line().alias("value"), F.struct("target_id", "observed_at").alias("seq"))
    parsed = lines.parse_observations(keyed)
    return parsed.select("seq.target_id", "seq.observed_at", F.col("error").isNull().alias("accepted"))


@query(
    "s3_v5_inventory_documents",
    with_views("SELECT target_id, observed_at, executable, n_tools FROM observations", "observations"),
)
def inventory_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _observation_rows(spark, sf).select("target_id", "observed_at", strict_inventory()(F.col("inventory_json")).alias("d"))
    return rows.filter("d.error IS NULL").select(
        "target_id", "observed_at", "d.executable", F.size("d.tools").cast("bigint").alias("n_tools")
    )


@query(
    "s2_a1_target_manifest",
    """SELECT count(*) AS records, count(*) FILTER (WHERE s_nationkey < 10) AS local_packages,
    count(*) FILTER (WHERE s_nationkey >= 10) AS remote_endpoints FROM supplier""",
)
def target_manifest(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("s_nationkey") < 10, "local_package").otherwise("remote_endpoint")
    line = F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"), F.col("s_name").alias("target_id"), F.lit("table").alias("source_type"), kind.alias("kind")
        )
    )
    path = scratch(spark, "targets")
    table(spark, sf, "supplier").select(line).write.text(path)
    return drift.manifest_summary(lines.read_targets(spark, path))


@query(
    "k1_observation_lines",
    with_views("SELECT target_id, observed_at, n_tools, TRUE AS compact FROM observations", "observations"),
)
def observation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice: scanned lines are normalized on the second write."""
    first, second = scratch(spark, "lines"), scratch(spark, "lines")
    publish.append_observations(_observation_rows(spark, sf), first)
    publish.append_observations(lines.read_observations(spark, first), second)
    rows = lines.read_observations(spark, second)
    return rows.select(
        "target_id", "observed_at", F.size("tools").cast("bigint").alias("n_tools"), (~F.contains("inventory_json", F.lit('": '))).alias("compact")
    )


@query(
    "v7_history_limits",
    with_views(
        """SELECT count(*) AS records, count(DISTINCT target_id) AS targets, count(*) <= 100000 AS records_ok,
        count(DISTINCT target_id) <= 100 AS targets_ok FROM observations""",
        "observations",
    ),
)
def history_limits(spark: SparkSession, sf: str) -> DataFrame:
    return lines.history_limits(v.observations(v.tools(spark, sf)), max_targets=100)


@query("v7_limited_scan", with_views("SELECT target_id, observed_at FROM observations", "observations"))
def limited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A log written from the tables passes a strict scan whose limits are just its size."""
    rows = v.observations(v.tools(spark, sf))
    path = scratch(spark, "limited")
    publish.append_observations(_observation_rows(spark, sf), path)
    size = rows.agg(F.count(F.lit(1)), F.countDistinct("target_id")).first()
    return lines.read_observations(spark, path, max_records=size[0], max_targets=size[1]).select("target_id", "observed_at")


@query(
    "w11_line_numbers",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents",
)
def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Ids written in order as one folder of text files, read back as numbered lines.

    File numbers continue from file to file: the offsets of the files come from their counts.
    """
    path = scratch(spark, "numbered")
    ids = table(spark, sf, "documents").select("doc_id").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    ids.select(F.col("doc_id").cast("string")).write.text(path)
    numbered = lines.number_lines(lines.read_lines(spark, path))
    placed = numbered.select(F.col("value").cast("bigint").alias("doc_id"), "file", "line_no")
    whole = ordering.global_position(placed, [F.asc("line_no")], F.struct("file", F.floor(F.col("line_no") / 100_000)), False, "position")
    return whole.select("doc_id", F.col("position").alias("line_no"))


@query(
    "w11_numbered_texts",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no, translate(coalesce(text, ''), chr(10) || chr(13), '  ') AS text FROM documents""",
)
def numbered_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts written in order, one to a line, and read back with their line numbers; as wide as the input asks for."""
    path = scratch(spark, "numbered")
    texts = table(spark, sf, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text")).write.text(path)
    numbered = lines.number_lines(lines.read_lines(spark, path))
    cut = F.locate("\t", F.col("value"))
    rows = numbered.select(F.substring("value", F.lit(1), cut - 1).cast("bigint").alias("doc_id"), F.substring("value", cut + 1, F.length("value")).alias("text"), "file", "line_no")
    counts = numbered.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    earlier = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return rows.join(F.broadcast(earlier), "file").select("doc_id", (F.col("line_no") + F.col("earlier")).alias("line_no"), "text")

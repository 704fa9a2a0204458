"""Run, rule, coverage and queue summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import SEVERITIES

FINDING_COUNTERS = (
    "finding_count",
    *[f"{s}_count" for s in SEVERITIES],
    "unreviewed_count",
    "unreviewed_high_count",
    "unreviewed_critical_count",
    "suspicious_count",
    "confirmed_risk_count",
)
FILE_COUNTERS = (
    "file_count",
    "total_file_bytes",
    "executable_count",
    "native_binary_count",
    "generated_count",
    "minified_count",
)
COUNTERS = (*FILE_COUNTERS, "dependency_count", *FINDING_COUNTERS)


def _is(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0).cast("bigint")


def finding_measures(severity: Column, disposition: Column) -> dict[str, Column]:
    """Counter increments of one finding."""
    open_ = disposition == "unreviewed"
    return {
        "finding_count": F.lit(1).cast("bigint"),
        **{f"{s}_count": _is(severity == s) for s in SEVERITIES},
        "unreviewed_count": _is(open_),
        "unreviewed_high_count": _is(open_ & (severity == "high")),
        "unreviewed_critical_count": _is(open_ & (severity == "critical")),
        "suspicious_count": _is(disposition == "suspicious"),
        "confirmed_risk_count": _is(disposition == "confirmed-risk"),
    }


def file_measures() -> dict[str, Column]:
    return {
        "file_count": F.lit(1).cast("bigint"),
        "total_file_bytes": F.col("byte_size").cast("bigint"),
        **{f"{f}_count": _is(F.col(f)) for f in ("executable", "native_binary", "generated", "minified")},
    }


def detail_deltas(findings: DataFrame | None, files: DataFrame | None, dependencies: DataFrame | None, run: str = "analysis_run_id") -> DataFrame:
    """Counter increments per run from detail rows: one aggregation over the stacked tables."""
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        return df.select(F.col(run).alias("analysis_run_id"), *[measures.get(c, zero).alias(c) for c in COUNTERS])

    parts = []
    if findings is not None:
        parts.append(part(findings, finding_measures(F.col("severity"), F.col("disposition"))))
    if files is not None:
        parts.append(part(files, file_measures()))
    if dependencies is not None:
        parts.append(part(dependencies, {"dependency_count": F.lit(1).cast("bigint")}))
    return merge_counters(reduce(DataFrame.unionByName, parts))


def merge_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("analysis_run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def run_summaries(runs: DataFrame, findings: DataFrame | None, files: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """One row per run with its eighteen counters; runs without detail rows get zeroes."""
    counters = detail_deltas(findings, files, dependencies).withColumnRenamed("analysis_run_id", "id")
    joined = runs.join(counters, "id", "left")
    zero = F.lit(0).cast("bigint")
    rest = [c for c in runs.columns if c != "id"]
    return joined.select(
        F.col("id").alias("analysis_run_id"), *rest, *[F.coalesce(c, zero).alias(c) for c in COUNTERS]
    )


def missing_summaries(runs: DataFrame, summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs without a summary row, oldest first when a batch size is given."""
    missing = runs.join(summaries.select(F.col("analysis_run_id").alias("id")), "id", "left_anti")
    return missing if limit is None else missing.orderBy("id").limit(limit)


def disposition_deltas(changes: DataFrame) -> DataFrame:
    """Signed counter changes per run from changed dispositions.

    ``changes``: analysis_run_id, severity, old_disposition, new_disposition.
    """
    real = changes.filter(F.col("old_disposition") != F.col("new_disposition"))
    sev = F.col("severity")
    new = finding_measures(sev, F.col("new_disposition"))
    old = finding_measures(sev, F.col("old_disposition"))
    moving = [c for c in FINDING_COUNTERS if c.startswith(("unreviewed", "suspicious", "confirmed"))]
    return real.groupBy("analysis_run_id").agg(*[F.sum(new[c] - old[c]).alias(c) for c in moving])


def apply_deltas(summaries: DataFrame, deltas: DataFrame) -> DataFrame:
    """Summaries with counter changes added; columns the deltas lack stay as they are."""
    changed = [c for c in deltas.columns if c != "analysis_run_id"]
    d = deltas.select("analysis_run_id", *[F.col(c).alias(f"_{c}") for c in changed])
    joined = summaries.join(d, "analysis_run_id", "left")
    return joined.select(
        *[
            (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) if c in changed else F.col(c)
            for c in summaries.columns
        ]
    )


METADATA = ("category", "severity", "title", "explanation")


def rule_definitions(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (ruleset, rule); other metadata for a rule inside a ruleset fails the job."""
    versions = runs.select(F.col("id").alias("analysis_run_id"), "ruleset_version")
    meta = F.struct(*METADATA)
    # Occurrences fold by run before they meet the run table. Distinct tuples are hashed; the least and the greatest
    # tuple of a run would sort every occurrence, since texts have no fixed place in a hash aggregation.
    per_run = findings.select("analysis_run_id", "rule_id", *METADATA).distinct()
    variants = per_run.join(versions, "analysis_run_id").select("ruleset_version", "rule_id", *METADATA).distinct()
    folded = variants.groupBy("ruleset_version", "rule_id").agg(F.min(meta).alias("m"), F.max(meta).alias("last"))
    problem = F.concat_ws(" ", F.lit("rule metadata changed within a ruleset:"), "ruleset_version", "rule_id")
    return folded.filter(
        F.when(F.col("m") != F.col("last"), F.raise_error(problem)).otherwise(F.lit(True))
    ).select("ruleset_version", "rule_id", "m.*")


def rule_occurrences(findings: DataFrame, run: str = "analysis_run_id", rule: str = "rule_id") -> DataFrame:
    return findings.groupBy(run, rule).agg(F.count(F.lit(1)).alias("occurrence_count"))


def severity_histogram(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per severity with zeroes for absent classes."""
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES]
    )


def _state(*names: str) -> Column:
    return F.count_if(F.col("state").isin(*names))


_ELIGIBLE = ("eligible", "running", "completed", "failed")


def _queue_counts() -> list[Column]:
    return [
        _state(*_ELIGIBLE).alias("eligible_package_records"),
        _state("completed").alias("completed_package_records"),
        _state("failed").alias("failed_package_records"),
        _state("unsupported").alias("unsupported_package_records"),
        _state("unresolvable").alias("unresolvable_package_records"),
        F.count_if((F.col("state") == "eligible") & (F.col("attempt_count") == 0)).alias("never_attempted_package_records"),
        _state("running").alias("running_package_records"),
        F.countDistinct(F.when(F.col("state") == "completed", F.col("artifact_sha256"))).alias("unique_artifacts_analyzed"),
    ]


def _finding_totals(weight: Column) -> list[Column]:
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value * weight), F.lit(0)).cast("bigint")

    return [
        *[total(F.col(f"{s}_count")).alias(f"{s}_findings") for s in SEVERITIES],
        total(F.col("unreviewed_count")).alias("unreviewed_findings"),
        total(F.col("unreviewed_high_count") + F.col("unreviewed_critical_count")).alias(
            "unreviewed_high_or_critical_findings"
        ),
        total(F.col("suspicious_count")).alias("suspicious_findings"),
        total(F.col("confirmed_risk_count")).alias("confirmed_risk_findings"),
    ]


def _coverage(queue: DataFrame, summaries: DataFrame, weight: Column) -> DataFrame:
    """Queue counts beside finding totals over the completed runs of each profile.

    Completed rows fold to (profile, run, uses) before they meet the summaries, so a run that
    very many packages share is one row in the join.
    """
    packages = queue.groupBy("profile_key").agg(*_queue_counts())
    used = (
        queue.filter((F.col("state") == "completed") & F.col("analysis_run_id").isNotNull())
        .groupBy("profile_key", "analysis_run_id")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    totals = (
        used.join(summaries, "analysis_run_id")
        .groupBy("profile_key")
        .agg(*_finding_totals(weight), F.count(F.lit(1)).alias("distinct_completed_runs"))
    )
    joined = packages.join(totals, "profile_key", "left")
    rest = [c for c in totals.columns if c != "profile_key"]
    return joined.select(*packages.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in rest])


def coverage_by_package(queue: DataFrame, summaries: DataFrame) -> DataFrame:
    """Coverage per profile in which a run counts once for every package that uses it."""
    return _coverage(queue, summaries, F.col("uses")).drop("distinct_completed_runs")


def coverage_by_run(queue: DataFrame, summaries: DataFrame) -> DataFrame:
    """Coverage per profile in which a shared run counts once. The authoritative totals."""
    return _coverage(queue, summaries, F.lit(1))


def static_queue_summary(queue: DataFrame) -> DataFrame:
    return queue.groupBy("profile_key").agg(
        F.count(F.lit(1)).alias("total_package_records"),
        _state(*_ELIGIBLE).alias("eligible_package_records"),
        _state("completed").alias("successfully_analyzed"),
        _state("failed").alias("failed_attempts"),
        _state("unsupported", "unresolvable").alias("unsupported_or_unresolvable"),
        F.count_if((F.col("state") == "eligible") & (F.col("attempt_count") == 0)).alias("never_attempted"),
        F.countDistinct(F.when(F.col("state") == "completed", F.col("artifact_sha256"))).alias("unique_artifacts_analyzed"),
        _state("running").alias("running"),
    )


def runtime_queue_summary(queue: DataFrame) -> DataFrame:
    done = F.col("state") == "completed"
    comparable = done & F.col("previous_compatible_run_id").isNotNull()
    zero = F.lit(0)
    moved = (
        F.coalesce("added_tools", zero) + F.coalesce("removed_tools", zero) + F.coalesce("modified_tools", zero)
    ) > 0
    return queue.groupBy("profile_key").agg(
        F.count(F.lit(1)).alias("total_package_records"),
        _state(*_ELIGIBLE).alias("eligible_package_records"),
        _state("completed").alias("completed_observations"),
        _state("failed").alias("failed_attempts"),
        _state("unsupported", "unresolvable").alias("unsupported_or_unresolvable"),
        F.count_if((F.col("state") == "eligible") & (F.col("attempt_count") == 0)).alias("never_attempted"),
        F.countDistinct(F.when(done, F.col("artifact_sha256"))).alias("unique_artifacts_observed"),
        _state("running").alias("running"),
        F.count_if(comparable).alias("comparable_observations"),
        F.count_if(comparable & moved).alias("drifted_observations"),
    )


def remaining_queue(queue: DataFrame, max_attempts: int) -> DataFrame:
    waiting = F.col("state").isin("eligible", "failed", "running") & (F.col("attempt_count") < max_attempts)
    return queue.groupBy("profile_key").agg(F.count_if(waiting).alias("remaining"))


def package_coverage(packages: DataFrame, runs: DataFrame, package: str = "package_id") -> DataFrame:
    """Packages, analyzed, failed and never analyzed; one package can be analyzed and failed.

    Runs fold to two flags per package before the join.
    """
    flags = runs.groupBy(F.col(package).alias("id")).agg(
        F.bool_or(F.col("status") == "completed").alias("analyzed"),
        F.bool_or(F.col("status") == "failed").alias("failed"),
        F.lit(True).alias("has_run"),
    )
    return (
        packages.select("id")
        .join(flags, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("package_records"),
            F.count_if(F.col("analyzed")).alias("analyzed_package_records"),
            F.count_if(F.col("failed")).alias("failed_package_records"),
            F.count_if(F.col("has_run").isNull()).alias("never_analyzed_package_records"),
        )
    )


def verify_publication(history: dict[str, DataFrame], hot: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table on both sides, and whether they agree."""
    parts = []
    for side, tables in (("history", history), ("hot", hot)):
        for name, df in tables.items():
            parts.append(
                df.agg(F.count(F.lit(1)).alias("n")).select(
                    F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n"
                )
            )
    rows = reduce(DataFrame.unionByName, parts)
    return (
        rows.groupBy("table_name")
        .agg(
            F.sum(F.when(F.col("side") == "history", F.col("n"))).alias("history"),
            F.sum(F.when(F.col("side") == "hot", F.col("n"))).alias("hot"),
        )
        .withColumn("equal", F.col("history").eqNullSafe(F.col("hot")))
    )

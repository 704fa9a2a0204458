"""Package work queues: synchronization, candidates, transitions, run verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.checks import runtime_eligibility, static_eligibility

# Fixed values.
INTERRUPTED = "interrupted"
STATIC_INTERRUPTED = "previous scheduler process did not finish this package"
RUNTIME_INTERRUPTED = "previous runtime scheduler did not finish this package"
# End of fixed values.

STATIC_PROFILE = ("analysis_type", "analyzer_name", "analyzer_version", "ruleset_version")


def _matches(profile: dict[str, str], names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & (F.col(name) == F.lit(profile[name]))
    return out


def compatible_runs(runs: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Newest completed run of the profile per package (a fold, not a sort)."""
    good = runs.filter(
        (F.col("status") == "completed") & F.col("artifact_sha256").isNotNull() & _matches(profile, STATIC_PROFILE)
    )
    return good.groupBy("package_id").agg(F.max(F.struct("id", "artifact_sha256")).alias("r")).select(
        "package_id", F.col("r.id").alias("run_id"), F.col("r.artifact_sha256").alias("run_artifact")
    )


def scheduled_runs(queue: DataFrame, runs: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Runs that completed queue rows already point at, still compatible with the profile."""
    good = runs.filter((F.col("status") == "completed") & _matches(profile, STATIC_PROFILE)).select(
        F.col("id").alias("analysis_run_id"), "artifact_sha256"
    )
    return (
        queue.filter("state = 'completed'")
        .select("package_id", "analysis_run_id", "artifact_sha256")
        .join(good, ["analysis_run_id", "artifact_sha256"])
        .select(
            "package_id",
            F.col("analysis_run_id").alias("own_run_id"),
            F.col("artifact_sha256").alias("own_artifact"),
        )
    )


def _stale(now: str, seconds: int) -> Column:
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(seconds))
    return (F.col("state") == "running") & F.coalesce(F.try_to_timestamp("last_attempt_at") <= cutoff, F.lit(False))


def _interrupt(rows: DataFrame, now: str, seconds: int, message: str) -> DataFrame:
    stale = _stale(now, seconds)
    # The condition reads state, so every column is computed from the same input row.
    values = {"state": "failed", "reason_code": INTERRUPTED, "reason_message": message, "updated_at": now}
    return rows.select(*[F.when(stale, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else c for c in rows.columns])


def synchronize_static(
    packages: DataFrame, queue: DataFrame, runs: DataFrame, profile: dict[str, str], key: str, now: str, stale_seconds: int
) -> DataFrame:
    """Next state of the archive-analysis queue of one profile.

    Every package gets a row: completed when a compatible run exists, else classified; failed
    and running rows of eligible packages are kept; stale running rows become failed.
    All joins are equi-joins on the package id.
    """
    mine = queue.filter(F.col("profile_key") == key)
    kept = [
        "state", "reason_code", "reason_message", "attempt_count", "analysis_run_id", "artifact_sha256",
        "reused_existing", "discovered_at", "last_attempt_at", "updated_at",
    ]
    old = mine.select("package_id", *[F.col(c).alias(f"old_{c}") for c in kept], F.lit(True).alias("known"))
    rows = (
        packages.select(F.col("id").alias("package_id"), "registry_type", "identifier", "version")
        .join(old, "package_id", "left")
        .join(compatible_runs(runs, profile), "package_id", "left")
        .join(scheduled_runs(mine, runs, profile), "package_id", "left")
        .withColumn("base", static_eligibility("registry_type", "identifier", "version"))
        .withColumn("done_run", F.coalesce("run_id", "own_run_id"))
        .withColumn("done_artifact", F.when(F.col("run_id").isNotNull(), F.col("run_artifact")).otherwise(F.col("own_artifact")))
    )
    done = F.col("done_run").isNotNull()
    keep = ~done & F.col("known") & F.col("old_state").isin("failed", "running") & (F.col("base.state") == "eligible")
    keep = F.coalesce(keep, F.lit(False))

    def choose(completed: Column, kept_value: Column, base: Column) -> Column:
        return F.when(done, completed).when(keep, kept_value).otherwise(base)

    none = F.lit(None).cast("string")
    desired = {
        "state": choose(F.lit("completed"), F.col("old_state"), F.col("base.state")),
        "reason_code": choose(none, F.nullif("old_reason_code", F.lit("")), F.col("base.reason_code")),
        "reason_message": choose(none, F.nullif("old_reason_message", F.lit("")), F.col("base.reason_message")),
        "analysis_run_id": choose(F.col("done_run"), F.col("old_analysis_run_id"), F.lit(None).cast("bigint")),
        "artifact_sha256": choose(F.col("done_artifact"), F.col("old_artifact_sha256"), none),
    }
    same = F.lit(True)
    for name, value in desired.items():
        same = same & value.eqNullSafe(F.col(f"old_{name}"))
    out = rows.select(
        F.lit(key).alias("profile_key"),
        "package_id",
        *[v.alias(n) for n, v in desired.items()],
        F.coalesce("old_attempt_count", F.lit(0)).alias("attempt_count"),
        F.coalesce("old_reused_existing", F.lit(False)).alias("reused_existing"),
        F.coalesce("old_discovered_at", F.lit(now)).alias("discovered_at"),
        F.col("old_last_attempt_at").alias("last_attempt_at"),
        F.when(F.col("known") & same, F.col("old_updated_at")).otherwise(F.lit(now)).alias("updated_at"),
    )
    return _interrupt(out.select(*queue.columns), now, stale_seconds, STATIC_INTERRUPTED)


RUNTIME_RESULT = (
    "runtime_observation_run_id",
    "artifact_sha256",
    "launch_profile_sha256",
    "previous_compatible_run_id",
    "added_tools",
    "removed_tools",
    "modified_tools",
    "unchanged_tools",
)


def valid_observations(queue: DataFrame, runs: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Package ids whose completed row points at a run of this guard and image."""
    good = runs.filter(
        (F.col("status") == "completed")
        & (F.col("guard_version") == F.concat(F.lit("sha256:"), F.lit(profile["guard_sha256"])))
        & (F.col("sandbox_image") == profile["runtime_image"])
        & F.col("artifact_sha256").isNotNull()
        & F.col("launch_profile_sha256").isNotNull()
    ).select(F.col("id").alias("runtime_observation_run_id"), "package_id")
    return queue.filter("state = 'completed'").join(
        good, ["runtime_observation_run_id", "package_id"], "left_semi"
    ).select("package_id", F.lit(True).alias("still_valid"))


def synchronize_runtime(
    packages: DataFrame, queue: DataFrame, runs: DataFrame, profile: dict[str, str], key: str, now: str, stale_seconds: int
) -> DataFrame:
    """Next state of the runtime-observation queue of one profile."""
    mine = queue.filter(F.col("profile_key") == key)
    carried = [c for c in queue.columns if c not in ("profile_key", "package_id")]
    old = mine.select("package_id", *[F.col(c).alias(f"old_{c}") for c in carried], F.lit(True).alias("known"))
    rows = (
        packages.select(F.col("id").alias("package_id"), "registry_type", "identifier", "version", "transport")
        .join(old, "package_id", "left")
        .join(valid_observations(mine, runs, profile), "package_id", "left")
        .withColumn("base", runtime_eligibility("registry_type", "transport", "identifier", "version"))
    )
    known = F.coalesce("known", F.lit(False))
    was = F.col("old_state")
    valid_done = known & (was == "completed") & F.coalesce("still_valid", F.lit(False))
    lost = known & (was == "completed") & ~F.coalesce("still_valid", F.lit(False))
    pending = known & was.isin("failed", "running") & (F.col("base.state") == "eligible")
    unmoved = known & (was == F.col("base.state")) & F.col("old_reason_code").eqNullSafe(F.col("base.reason_code"))
    keep = F.coalesce(valid_done | pending | (unmoved & ~lost), F.lit(False))
    values = {
        "state": F.when(keep, was).otherwise(F.col("base.state")),
        "reason_code": F.when(keep, F.col("old_reason_code")).otherwise(F.col("base.reason_code")),
        "reason_message": F.when(keep, F.col("old_reason_message")).otherwise(F.col("base.reason_message")),
        "attempt_count": F.coalesce("old_attempt_count", F.lit(0)),
        "discovered_at": F.coalesce("old_discovered_at", F.lit(now)),
        "last_attempt_at": F.col("old_last_attempt_at"),
        "updated_at": F.when(keep, F.col("old_updated_at")).otherwise(F.lit(now)),
        **{c: F.when(~F.coalesce(lost, F.lit(False)), F.col(f"old_{c}")) for c in RUNTIME_RESULT},
    }
    out = rows.select(
        *[F.lit(key).alias(c) if c == "profile_key" else F.col(c) if c == "package_id" else values[c].alias(c) for c in queue.columns]
    )
    return _interrupt(out, now, stale_seconds, RUNTIME_INTERRUPTED)


def register_profile(profiles: DataFrame, key: str, fields: dict[str, str], now: str) -> DataFrame:
    """Profiles with this one added, or its selection time renewed."""
    spark = profiles.sparkSession
    values = {"profile_key": key, **fields, "created_at": now, "selected_at": now}
    one = spark.range(1).select(*[F.lit(values[c]).cast("string").alias(c) for c in profiles.columns])
    both = profiles.withColumn("_new", F.lit(False)).unionByName(one.withColumn("_new", F.lit(True)))
    latest = ("selected_at",)
    return both.groupBy("profile_key").agg(
        *[
            (F.max_by(c, "_new") if c in latest else F.min_by(c, "_new")).alias(c)
            for c in profiles.columns
            if c != "profile_key"
        ]
    )


def candidates(
    queue: DataFrame, packages: DataFrame, versions: DataFrame, key: str, now: str, max_attempts: int, retry_seconds: int, batch: int
) -> DataFrame:
    """Next packages of one profile (``key``) to work on: newest discovery, eligible first, fewest attempts, highest id.

    The batch is chosen by a top-k over the queue before the names are joined, so the joins see
    only ``batch`` rows. Queue rows of packages that do not exist are left out beforehand.
    """
    due = queue.filter(
        (F.col("profile_key") == key)
        & F.col("state").isin("eligible", "failed")
        & (F.col("attempt_count") < max_attempts)
        & text.retry_due("last_attempt_at", now, retry_seconds)
    ).join(packages.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    order = [
        F.desc("discovered_at"),
        F.when(F.col("state") == "eligible", 0).otherwise(1),
        F.asc("attempt_count"),
        F.desc("package_id"),
    ]
    top = due.orderBy(*order).limit(batch)
    named = top.join(
        packages.select(F.col("id").alias("package_id"), "server_version_id", F.col("identifier").alias("package_identifier")),
        "package_id",
    ).join(versions.select(F.col("id").alias("server_version_id"), "server_identifier", "server_version"), "server_version_id")
    return named.orderBy(*order).select("package_id", "server_identifier", "server_version", "package_identifier")


def drill_down(queue: DataFrame, kind: str, key: str, limit: int = 50) -> DataFrame:
    """Newest queue rows of one profile (``key``) that are completed, never attempted, or eligible in the wide sense."""
    condition = {
        "completed": F.col("state") == "completed",
        "never_attempted": (F.col("state") == "eligible") & (F.col("attempt_count") == 0),
        "eligible": F.col("state").isin("eligible", "running", "completed", "failed"),
    }[kind]
    return (
        queue.filter(condition & (F.col("profile_key") == key))
        .orderBy(F.desc("updated_at"), F.desc("package_id"))
        .limit(limit)
        .select("package_id")
    )


def apply_transitions(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Apply a batch of claim and result events.

    ``events``: profile_key, package_id, seq, kind (claim | result), at, and the result columns
    state, reason_code, reason_message, analysis_run_id, artifact_sha256, reused_existing. The
    order of events decides; per package they fold to the last event and the number of claims.
    """
    keys = ["profile_key", "package_id"]
    result = ["state", "reason_code", "reason_message", "analysis_run_id", "artifact_sha256", "reused_existing"]
    claim = F.col("kind") == "claim"
    is_result = F.col("kind") == "result"
    folded = events.groupBy(*keys).agg(
        F.count_if(claim).alias("claims"),
        F.max(F.when(claim, F.struct("seq", "at"))).alias("last_claim"),
        F.max_by(F.struct("kind", "at"), "seq").alias("last"),
        F.max_by(F.struct(*result), F.when(is_result, F.col("seq"))).alias("res"),
    )
    joined = queue.join(folded, keys, "left")
    touched, claimed_last = F.col("last").isNotNull(), F.col("last.kind") == "claim"
    had_result = F.col("res").isNotNull()
    none = F.lit(None).cast("string")
    message = F.nullif(text.bounded_message(F.coalesce("res.reason_message", F.lit(""))), F.lit(""))
    values = {
        "state": F.when(claimed_last, F.lit("running")).when(had_result, F.col("res.state")).otherwise(F.col("state")),
        "reason_code": F.when(claimed_last, none).when(had_result, F.col("res.reason_code")).otherwise(F.col("reason_code")),
        "reason_message": F.when(claimed_last, none).when(had_result, message).otherwise(F.col("reason_message")),
        "attempt_count": F.col("attempt_count") + F.coalesce("claims", F.lit(0)).cast("int"),
        "analysis_run_id": F.when(had_result, F.col("res.analysis_run_id")).otherwise(F.col("analysis_run_id")),
        "artifact_sha256": F.when(had_result, F.col("res.artifact_sha256")).otherwise(F.col("artifact_sha256")),
        "reused_existing": F.when(had_result, F.col("res.reused_existing")).otherwise(F.col("reused_existing")),
        "last_attempt_at": F.coalesce("last_claim.at", "last_attempt_at"),
        "updated_at": F.when(touched, F.col("last.at")).otherwise(F.col("updated_at")),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in queue.columns])


def verify_completed(queue: DataFrame, runs: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Completed queue rows with whether an equal, completed run of the profile backs them."""
    good = runs.filter((F.col("status") == "completed") & _matches(profile, STATIC_PROFILE)).select(
        F.col("id").alias("analysis_run_id"), "artifact_sha256", F.lit(True).alias("verified")
    )
    return (
        queue.filter("state = 'completed'")
        .join(good, ["analysis_run_id", "artifact_sha256"], "left")
        .select("profile_key", "package_id", "analysis_run_id", F.coalesce("verified", F.lit(False)).alias("verified"))
    )


def resolve_packages(requests: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """Exact package of each (server, version, package) request, or why there is none.

    Several rows are fine when they name one artifact; the lowest position wins. A request's
    matches fold to counts and one struct, whatever their number. Packages that nobody asks for go by their whole key,
    by which the requests lie already, before the fold.
    """
    pair = ["server_identifier", "server_version"]
    named = packages.join(versions.select(F.col("id").alias("server_version_id"), *pair), "server_version_id").select(
        "server_identifier",
        "server_version",
        F.col("identifier").alias("package_identifier"),
        F.struct("position", F.col("id").alias("package_id"), "registry_type", "version").alias("m"),
    )
    keys = ["server_identifier", "server_version", "package_identifier"]
    artifact = F.struct(F.col("m.registry_type"), F.coalesce("m.version", F.lit("\u0000")))
    folded = (
        named.join(requests.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min("m").alias("first"), F.min(artifact).alias("a"), F.max(artifact).alias("z"))
    )
    joined = requests.join(folded, keys, "left")
    status = (
        F.when(F.col("first").isNull(), "package_not_found")
        .when(F.col("a") != F.col("z"), "ambiguous_package")
        .when(~F.col("first.registry_type").isin("npm", "pypi"), "unsupported_registry")
        .when(F.coalesce("first.version", F.lit("")) == "", "missing_version")
        .otherwise("resolved")
    )
    return joined.select(
        *keys,
        status.alias("status"),
        F.when(status == "resolved", F.col("first.package_id")).alias("package_id"),
    )

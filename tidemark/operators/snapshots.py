"""Snapshot order, membership, additions and removals, import splits, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_position, newest_per_key

LIST_LIMIT = 500


def order_snapshots(snapshots: DataFrame, time: str = "completed_at", id: str = "id") -> DataFrame:
    """All snapshots with ``ordinal`` 1 for the newest; times compare as text, then by id."""
    return global_position(
        snapshots, [F.desc(time), F.desc(id)], F.substring(F.col(time), 1, 7), True, "ordinal"
    )


def latest_snapshots(snapshots: DataFrame, count: int = 2, time: str = "completed_at", id: str = "id") -> DataFrame:
    """The newest ``count`` snapshots (a top-k, no global sort), with ``ordinal``."""
    top = snapshots.orderBy(F.desc(time), F.desc(id)).limit(count)
    best = top.withColumn("_one", F.lit(1))
    return newest_per_key(best, ["_one"], [F.desc(time), F.desc(id)], count, "ordinal").drop("_one")


def snapshot_pair(snapshots: DataFrame, time: str = "completed_at", id: str = "id") -> DataFrame:
    """One row ``(latest_id, previous_id, both_full)``.

    ``both_full`` tells whether absence from the latest snapshot means removal; snapshots
    without a recorded collection mode count as full.
    """
    mode = F.col("collection_mode") if "collection_mode" in snapshots.columns else F.lit("full")
    ranked = latest_snapshots(snapshots.withColumn("_full", F.coalesce(mode, F.lit("full")) == "full"), 2, time, id)
    return ranked.agg(
        F.bool_and("_full").alias("both_full"),
        F.max(F.when(F.col("ordinal") == 1, F.col(id))).alias("latest_id"),
        F.max(F.when(F.col("ordinal") == 2, F.col(id))).alias("previous_id"),
    )


def select_snapshot(snapshots: DataFrame, pinned=None, time: str = "completed_at", id: str = "id") -> DataFrame:
    """The pinned snapshot (by id or digest), or the newest. At most one row."""
    if pinned is None:
        return snapshots.orderBy(F.desc(time), F.desc(id)).limit(1)
    by_digest = isinstance(pinned, str) and "snapshot_sha256" in snapshots.columns
    return snapshots.filter(F.col("snapshot_sha256" if by_digest else id) == F.lit(pinned)).limit(1)


def snapshot_members(links: DataFrame, selected: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Links of the selected snapshot, joined to their versions when given.

    ``selected`` has at most one row, so its id is a scalar subquery that prunes the
    ``snapshot_id`` partitions of the link table.
    """
    only = links.filter(F.col("snapshot_id") == selected.select("id").scalar())
    if versions is None:
        return only
    return only.join(versions, only["server_version_id"] == versions["id"]).drop(versions["id"])


def presence(links: DataFrame, pair: DataFrame, members: list[str], snapshot: str = "snapshot_id") -> DataFrame:
    """Members of either snapshot of a pair with ``in_latest`` and ``in_previous``.

    One aggregation over the two snapshots' links answers additions, removals and the unchanged
    set together; map-side combining keeps one row per member and task.
    """
    # One struct subquery: every use below is the same subplan, which Spark runs once.
    p = pair.select(F.struct(*pair.columns)).scalar()
    at_latest, at_previous = F.col(snapshot) == p["latest_id"], F.col(snapshot) == p["previous_id"]
    folded = (
        links.select(*members, at_latest.alias("_latest"), at_previous.alias("_previous"))
        .filter(F.col("_latest") | F.col("_previous"))
        .groupBy(*members)
        .agg(
            F.coalesce(F.bool_or("_latest"), F.lit(False)).alias("in_latest"),
            F.coalesce(F.bool_or("_previous"), F.lit(False)).alias("in_previous"),
        )
    )
    return folded.select(
        "*", p["previous_id"].isNotNull().alias("has_previous"), p["both_full"].alias("both_full")
    )


def additions(marked: DataFrame) -> DataFrame:
    """Members new in the latest snapshot; none when there is no previous one."""
    return marked.filter(F.col("in_latest") & ~F.col("in_previous") & F.col("has_previous"))


def removals(marked: DataFrame, raw: bool = False) -> DataFrame:
    """Members gone from the latest snapshot.

    Absence from an incremental snapshot says nothing, so only pairs of full snapshots have
    removals; ``raw`` gives the literal comparison.
    """
    gone = F.col("in_previous") & ~F.col("in_latest")
    return marked.filter(gone if raw else gone & F.col("both_full"))


def unchanged(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("in_latest") & F.col("in_previous"))


def change_listing(changed: DataFrame, versions: DataFrame, member: str = "server_version_id", limit: int = LIST_LIMIT) -> DataFrame:
    """The first ``limit`` changed versions by identifier and version, with digest prefix."""
    rows = versions.join(changed.select(F.col(member).alias("id")), "id", "left_semi")
    return (
        rows.select(
            "id",
            "server_identifier",
            "server_version",
            "registry_status",
            "published_at",
            "updated_at",
            F.substring("canonical_sha256", 1, 16).alias("canonical_sha256_prefix"),
        )
        .orderBy("server_identifier", "server_version", "id")
        .limit(limit)
    )


def snapshot_diffs(links: DataFrame, ordinals: DataFrame, member: str, snapshot: str = "snapshot_id") -> DataFrame:
    """Additions and removals between every two consecutive snapshots.

    ``ordinals`` maps a snapshot to its 1-based position in time. Each link marks its own
    position and, shifted by one, the next: grouping by (position, member) then sees both sides
    of every pair in one pass, spread over positions and members.
    """
    last = ordinals.agg(F.max("position").alias("m")).scalar()
    placed = links.join(ordinals, snapshot)
    marks = placed.select(
        member,
        F.explode(
            F.array(
                F.struct(F.col("position"), F.lit(True).alias("here")),
                F.struct((F.col("position") + 1).alias("position"), F.lit(False).alias("here")),
            )
        ).alias("mark"),
    ).select(member, "mark.position", "mark.here")
    folded = marks.groupBy("position", member).agg(
        F.bool_or("here").alias("now"), F.bool_or(~F.col("here")).alias("before")
    )
    return folded.filter((F.col("position").between(2, last)) & (F.col("now") != F.col("before"))).select(
        "position", member, F.when(F.col("now"), "added").otherwise("removed").alias("change")
    )


def split_incoming(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Classify incoming records by identity triple: ``reused``, ``changed`` or ``new``.

    ``changed`` is a new digest under a known (identifier, version). Stored versions are read once;
    one shuffle by the pair serves the fold to triples and the look at the pair's other variants.
    """
    pair = ["server_identifier", "server_version"]
    tagged = incoming.select(*pair, "canonical_sha256", F.lit(True).alias("incoming")).unionByName(
        existing.select(*pair, "canonical_sha256", F.lit(False).alias("incoming"))
    )
    triples = tagged.repartition(*pair).groupBy(*pair, "canonical_sha256").agg(
        F.bool_or("incoming").alias("incoming"), F.bool_or(~F.col("incoming")).alias("stored")
    )
    return (
        triples.withColumn("known", F.max("stored").over(Window.partitionBy(*pair)))
        .filter("incoming")
        .select(
            *pair,
            "canonical_sha256",
            F.when(F.col("stored"), "reused")
            .when(F.col("known"), "changed")
            .otherwise("new")
            .alias("outcome"),
        )
    )


def import_statistics(outcomes: DataFrame) -> DataFrame:
    """Records, inserted, reused and changed counts of a classified import."""

    def of(*kinds: str) -> Column:
        return F.count_if(F.col("outcome").isin(*kinds))

    return outcomes.agg(
        F.count(F.lit(1)).alias("records"),
        of("new", "changed").alias("inserted_records"),
        of("reused").alias("reused_records"),
        of("changed").alias("changed_identity_records"),
        F.count(F.lit(1)).alias("links"),
        F.countDistinct("server_identifier").alias("unique_names"),
    )


def current_state(links: DataFrame, snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest variant per (identifier, version) over full and incremental snapshots."""
    seen = links.join(
        snapshots.select(F.col("id").alias("snapshot_id"), F.col("completed_at").alias("seen_at")), "snapshot_id"
    )
    last = seen.groupBy("server_version_id").agg(
        F.max(F.struct("seen_at", "snapshot_id")).alias("seen")
    )
    joined = versions.join(last, versions["id"] == last["server_version_id"])
    best = newest_per_key(
        joined,
        ["server_identifier", "server_version"],
        [F.desc("seen"), F.desc("id")],
    )
    return best.select("id", "server_identifier", "server_version", F.col("seen.snapshot_id").alias("snapshot_id"))


def refresh_baseline(snapshots: DataFrame) -> DataFrame:
    """Provenance of the newest snapshot: what an incremental collection starts from."""
    return select_snapshot(snapshots).select(
        F.col("snapshot_sha256").alias("base_snapshot_sha256"),
        F.col("completed_at").alias("updated_since"),
        F.lit("incremental").alias("collection_mode"),
    )


def sync_table(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Compare an append-only pair by key: ``outcome`` is insert, validated or mismatch.

    Both sides are folded by key in one aggregation: a source row and a target row of one key
    meet in one group of at most two rows.
    """
    if source.columns != target.columns:
        raise ValueError("column lists differ")
    rest = [c for c in source.columns if c not in keys]
    body = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    both = source.withColumn("_src", F.lit(True)).unionByName(target.withColumn("_src", F.lit(False)))
    folded = both.groupBy(*keys).agg(
        F.min_by(body, ~F.col("_src")).alias("_first"),
        F.max_by(body, ~F.col("_src")).alias("_second"),
        F.bool_or("_src").alias("_in_source"),
        F.bool_or(~F.col("_src")).alias("_in_target"),
    )
    return folded.filter("_in_source").select(
        *keys,
        F.when(~F.col("_in_target"), "insert")
        .when(F.col("_first").eqNullSafe(F.col("_second")), "validated")
        .otherwise("mismatch")
        .alias("outcome"),
    )


def sync_statistics(outcomes: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind)

    return outcomes.agg(
        of("insert").alias("inserted"), of("validated").alias("validated"), of("mismatch").alias("mismatched")
    )


def synced(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the rows only the source has; a differing row fails the job."""
    outcomes = sync_table(source, target, keys)
    problem = F.concat_ws(" ", F.lit("immutable row differs:"), *[F.col(k).cast("string") for k in keys])
    checked = outcomes.filter(
        F.when(F.col("outcome") == "mismatch", F.raise_error(problem)).otherwise(F.col("outcome") == "insert")
    )
    return target.unionByName(source.join(checked.select(*keys), keys, "left_semi"))


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two tables, with both counts."""
    columns = left.columns
    both = left.withColumn("_l", F.lit(1)).unionByName(right.withColumn("_l", F.lit(0)))
    return (
        both.groupBy(*columns)
        .agg(F.sum("_l").alias("left_copies"), F.sum(1 - F.col("_l")).alias("right_copies"))
        .filter(F.col("left_copies") != F.col("right_copies"))
    )

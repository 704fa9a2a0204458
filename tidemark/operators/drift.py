"""Observation history and tool drift, in row form so that no inventory is held in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .ordering import newest_per_key

PARTS = 64  # of the versions of one group that are folded on their own


def manifest_summary(targets: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return targets.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(kind == "local_package").alias("local_packages"),
        F.count_if(kind == "remote_endpoint").alias("remote_endpoints"),
    )


def history_summary(observations: DataFrame, time: str = "observed_at", target: str = "target_id") -> DataFrame:
    return observations.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct(target).alias("targets"),
        F.min(time).alias("earliest_observed_at"),
        F.max(time).alias("latest_observed_at"),
    )


def latest_two(observations: DataFrame, target: str = "target_id", time: str = "observed_at", seq: str = "seq") -> DataFrame:
    """Latest (``rank`` 1) and previous (2) observation per target; later lines win ties."""
    return newest_per_key(observations, [target], [F.desc(time), F.desc(seq)], 2)


def tool_rows(observations: DataFrame, keep: list[str]) -> DataFrame:
    """Inventory arrays exploded to ``(keep..., name, definition)``."""
    return observations.select(*keep, F.explode("tools").alias("tool")).select(
        *keep, F.col("tool.name").alias("name"), F.col("tool.definition").alias("definition")
    )


def compare_tools(rows: DataFrame, keys: list[str], newer: Column, name: str = "name", definition: str = "definition") -> DataFrame:
    """Class of every tool of a before/after pair: added, removed, modified or unchanged.

    ``rows`` holds both inventories and ``newer`` tells them apart. Grouping by (pair, tool)
    merges them in one shuffle; a pair with very many tools spreads over its tool names.
    """
    sided = rows.withColumn("_new", newer)
    folded = sided.groupBy(*keys, name).agg(
        F.max(F.when(~F.col("_new"), F.col(definition))).alias("before"),
        F.max(F.when(F.col("_new"), F.col(definition))).alias("after"),
        F.bool_or(~F.col("_new")).alias("in_before"),
        F.bool_or("_new").alias("in_after"),
    )
    change = (
        F.when(~F.col("in_before"), "added")
        .when(~F.col("in_after"), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged")
        .otherwise("modified")
    )
    return folded.select(*keys, name, change.alias("change"))


def drift_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: counts per class and whether anything but ``unchanged`` occurred."""

    def of(kind: str) -> Column:
        return F.count_if(F.col("change") == kind)

    return (
        changes.groupBy(*keys)
        .agg(
            of("added").alias("added"),
            of("removed").alias("removed"),
            of("modified").alias("modified"),
            of("unchanged").alias("unchanged"),
        )
        .withColumn("drifted", F.col("added") + F.col("removed") + F.col("modified") > 0)
    )


def drift_verdict(counts: DataFrame, executables: DataFrame, keys: list[str]) -> DataFrame:
    """``identical`` or ``material_drift``; a changed executable is drift of its own.

    ``executables`` has ``executable_before`` and ``executable_after`` per pair; pairs whose
    inventories are both empty have no counts and are judged by the executable alone.
    """
    joined = executables.join(counts, keys, "left")
    for c in ("added", "removed", "modified", "unchanged"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    changed = ~F.col("executable_before").eqNullSafe(F.col("executable_after"))
    drifted = changed | F.coalesce("drifted", F.lit(False))
    return joined.select(
        *keys,
        "added",
        "removed",
        "modified",
        "unchanged",
        changed.alias("executable_changed"),
        F.when(drifted, "material_drift").otherwise("identical").alias("verdict"),
    )


def with_predecessor(two: DataFrame, target: str = "target_id") -> DataFrame:
    """Rows of the targets that have two observations. Rows are already grouped by target for
    the ranking, so this adds no shuffle and does not read the log again."""
    size = F.max("rank").over(Window.partitionBy(target))
    return two.withColumn("_n", size).filter("_n = 2").drop("_n")


def latest_drift(observations: DataFrame) -> DataFrame:
    """Tool changes between the two newest observations of each target that has two."""
    rows = tool_rows(with_predecessor(latest_two(observations)), ["target_id", "rank"])
    return compare_tools(rows, ["target_id"], F.col("rank") == 1)


def latest_verdicts(observations: DataFrame) -> DataFrame:
    """Drift verdict per target with two observations."""
    two = with_predecessor(latest_two(observations))
    sides = two.groupBy("target_id").agg(
        F.max(F.when(F.col("rank") == 2, F.col("executable"))).alias("executable_before"),
        F.max(F.when(F.col("rank") == 1, F.col("executable"))).alias("executable_after"),
    )
    return drift_verdict(drift_counts(latest_drift(observations), ["target_id"]), sides, ["target_id"])


def with_neighbours(tools: DataFrame, times: DataFrame, target: str, time: str, chunk: Column) -> DataFrame:
    """The tool rows with ``_next``, the target's next observation time after theirs, and ``_has_before``.

    ``chunk`` is a coarse, monotone image of the time. Observations and tools of one chunk are ordered together, so a tool
    row finds the next time in its chunk without a join; at the end of a chunk the first time of the target's next
    chunk is taken from a table with one row for each target and chunk.
    """
    edges = times.select(target, time, chunk.alias("_chunk")).groupBy(target, "_chunk").agg(F.min(time).alias("_first"))
    across = Window.partitionBy(target).orderBy("_chunk")
    borders = edges.select(
        target, "_chunk", "_first", F.lead("_first").over(across).alias("_following"), F.lag("_first").over(across).isNotNull().alias("_later")
    )
    names = F.lit(None).cast(tools.schema["name"].dataType), F.lit(None).cast(tools.schema["definition"].dataType)
    marks = times.select(target, time, names[0].alias("name"), names[1].alias("definition"), F.lit(False).alias("_tool"))
    rows = tools.select(target, time, "name", "definition", F.lit(True).alias("_tool")).unionByName(marks).withColumn("_chunk", chunk)
    down = Window.partitionBy(target, "_chunk").orderBy(F.desc(time))
    later = F.lag(time).over(down)
    stepped = rows.withColumn("_step", F.when(later != F.col(time), later))
    nearest = F.last("_step", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = stepped.withColumn("_near", nearest).filter("_tool").join(borders, [target, "_chunk"])
    return placed.select(
        target,
        time,
        "name",
        "definition",
        F.coalesce("_near", "_following").alias("_next"),
        (F.col("_later") | (F.col(time) > F.col("_first"))).alias("_has_before"),
    )


def consecutive_diffs(tools: DataFrame, times: DataFrame, target: str, time: str, chunk: Column) -> DataFrame:
    """Tool changes between every two consecutive observations of each target.

    ``times`` lists the observations ``(target, time)``. Tools are read once: each row is the newer side at its own time
    and the older side at the next time, and grouping by (target, time, tool) classifies all pairs in one pass.
    """
    sides = F.explode(
        F.array(
            F.struct(F.when(F.col("_has_before"), F.col(time)).alias("at"), F.lit(True).alias("newer")),
            F.struct(F.col("_next").alias("at"), F.lit(False).alias("newer")),
        )
    ).alias("_side")
    both = with_neighbours(tools, times, target, time, chunk).select(target, "name", "definition", sides)
    rows = both.select(target, F.col("_side.at").alias(time), "name", "definition", "_side.newer").filter(F.col(time).isNotNull())
    return compare_tools(rows, [target, time], F.col("newer"))


def previous_compatible_runs(runs: DataFrame) -> DataFrame:
    """Per completed run: the newest other run of the same profile, server and package
    that belongs to another version.

    ``runs``: profile_key, run_id, server_version_id, server_identifier, package_identifier,
    recency. Newest means largest (recency, run_id) over the whole group, so each version folds
    to its best run and each group to its two best versions before anything is paired: the
    answer for a version is the group's best, unless that best is of the version itself.

    Few groups may hold all runs. Folding combines before each shuffle; back at the runs, groups with more than a
    thousandth of them are broadcast (they are fewer than a thousand), the others are joined by key.
    """
    group = ["profile_key", "server_identifier", "package_identifier"]
    per_version = runs.groupBy(*group, "server_version_id").agg(
        F.max(F.struct("recency", "run_id")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    # one partial answer for each group and part of its versions, then the two best of these
    part = F.pmod(F.xxhash64("server_version_id"), F.lit(PARTS))
    best_two = F.slice(F.sort_array(F.collect_list(F.struct("best", "server_version_id")), asc=False), 1, 2)
    parts = newest_per_key(per_version.withColumn("_part", part), [*group, "_part"], [F.desc("best")], 2)
    folded = parts.groupBy(*group).agg(best_two.alias("two"))  # 2 * PARTS entries at most
    sizes = per_version.groupBy(*group).agg(F.sum("n").alias("n"))
    folded = folded.join(sizes, group).select(*group, "n", F.get("two", F.lit(0)).alias("first"), F.get("two", F.lit(1)).alias("second"))
    folded = staged(folded, "groups")
    own = F.col("first.server_version_id") == F.col("server_version_id")
    other = F.when(own, F.col("second.best.run_id")).otherwise(F.col("first.best.run_id"))
    large = F.col("n") > folded.agg(F.sum("n") / 1000).scalar()
    hot = F.broadcast(folded.filter(large))
    others = runs.join(hot.select(*group), group, "left_anti").join(folded.filter(~large), group, "left")
    return runs.join(hot, group).unionByName(others).select(
        *group, "server_version_id", "run_id", other.alias("previous_run_id")
    )


def name_sets(before: Column, after: Column) -> Column:
    """Array form for two inventories already on one row."""
    return F.struct(
        F.sort_array(F.array_except(after, before)).alias("added"),
        F.sort_array(F.array_except(before, after)).alias("removed"),
        F.sort_array(F.array_intersect(before, after)).alias("common"),
    )

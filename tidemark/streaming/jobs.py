"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.documents import compact_text, item_texts
from ..operators.imports import import_bundle, not_imported
from ..operators.summaries import detail_deltas, merge_counters
from ..sinks.publish import _path
from ..sources.bundles import is_completed

_ROW = "target_id string, observed_at string, seq bigint, inventory string"
_STATE = "at1 string, seq1 bigint, inv1 string, at2 string, seq2 bigint, inv2 string"
CHANGES = (
    "target_id string, latest_at string, latest_seq bigint, previous_at string, previous_seq bigint, "
    "added bigint, removed bigint, modified bigint, unchanged bigint"
)


def _newest_two(frame: pd.DataFrame) -> pd.DataFrame:
    ordered = frame.sort_values(["observed_at", "seq"], ascending=False)
    return ordered.groupby("target_id", sort=False).head(2)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _newest_two(batch)


def _tools(inventory: str | None) -> dict[str, str]:
    """Tool definitions by name, as written but for white space: 1.0 and 1.00 differ, as in the batch form."""
    items = item_texts(f'{{"tools":{inventory or "[]"}}}', "tools") or []
    return {json.loads(t)["name"]: compact_text(t) for t in items}


def _change_row(target: str, state: tuple) -> dict:
    at1, seq1, inv1, at2, seq2, inv2 = state
    row = dict(target_id=target, latest_at=at1, latest_seq=seq1, previous_at=at2, previous_seq=seq2)
    counts = dict.fromkeys(("added", "removed", "modified", "unchanged"))
    if at2 is not None:
        new, old = _tools(inv1), _tools(inv2)
        common = new.keys() & old.keys()
        modified = sum(new[k] != old[k] for k in common)
        counts = dict(
            added=len(new.keys() - old.keys()),
            removed=len(old.keys() - new.keys()),
            modified=modified,
            unchanged=len(common) - modified,
        )
    return {**row, **counts}


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at1, seq1, inv1, at2, seq2, inv2 = state.get if state.exists else (None,) * 6
    seen = [(a, s, i) for a, s, i in ((at1, seq1, inv1), (at2, seq2, inv2)) if a is not None]
    before = seen[:]
    for batch in batches:
        rows = zip(batch["observed_at"], batch["seq"], batch["inventory"])
        seen = sorted({*seen, *((a, int(s), i) for a, s, i in rows)}, key=lambda r: r[:2], reverse=True)[:2]
    if seen != before:
        first, second = seen[0], seen[1] if len(seen) > 1 else (None, None, None)
        state.update((*first, *second))
        yield pd.DataFrame([_change_row(key[0], (*first, *second))]).astype(
            {c: "Int64" for c in ("previous_seq", "added", "removed", "modified", "unchanged")}
        )


def latest_two_stream(observations: DataFrame) -> DataFrame:
    """Stream of ``(target_id, observed_at, seq, inventory)`` to the changing top two per target.

    Input may arrive in any order and arbitrarily late: the state is the two newest rows of a
    target by (observed_at, seq). Tasks keep only their own two newest rows per target and Arrow
    batch before the shuffle, so a very frequent target does not concentrate the input.
    """
    combined = observations.select("target_id", "observed_at", "seq", "inventory").mapInPandas(_combine, _ROW)
    return combined.groupBy("target_id").applyInPandasWithState(
        _fold, CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def drift_alerts(changes: DataFrame) -> DataFrame:
    """Rows of the top-two stream whose two inventories differ."""
    moved = F.col("added") + F.col("removed") + F.col("modified")
    return changes.filter(F.coalesce(moved, F.lit(0)) > 0)


def _by_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        # The batch number names the folder, so a replayed batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available input, one output folder per batch."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(_by_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def newest_states(spark: SparkSession, path: str) -> DataFrame:
    """Last emitted row per target of a finished top-two stream."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("batch", "target_id")]
    return (
        rows.groupBy("target_id")
        .agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        .select("target_id", "r.*")
    )


def summarize_stream(findings: DataFrame, path: str, checkpoint: str) -> None:
    """Maintain run counters from a stream of findings.

    Each batch folds to one increment per run and is stored as its own folder; counters are the
    sum over folders, so replays do not count twice and no stored row is rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        detail_deltas(batch, None, None).write.mode("overwrite").parquet(f"{path}/batch={number}")

    (
        findings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def streamed_counters(spark: SparkSession, path: str) -> DataFrame:
    return merge_counters(spark.read.parquet(path).drop("batch"))


def _waiting(spark: SparkSession, root: str, before: int | None) -> list[str]:
    """Bundles that had no marker yet when the last batch (before a number) was done."""
    numbers = [n for n in _waiting_batches(spark, root) if before is None or n < before]
    return [r[0] for r in spark.read.text(f"{root}/_waiting/batch={max(numbers)}").collect()] if numbers else []


def _waiting_batches(spark: SparkSession, root: str) -> list[int]:
    pattern, fs = _path(spark, f"{root}/_waiting/batch=*/_SUCCESS")
    return [int(s.getPath().getParent().getName().split("=")[1]) for s in (fs.globStatus(pattern) or [])]


def import_arrived(spark: SparkSession, found: list[str], root: str, imported_at: str) -> list[str]:
    """Import those of some bundles that are complete and not known; returns those without a marker yet.

    The work follows the bundles given: known ones are left out by one join of their digests.
    """
    ready = [b for b in found if is_completed(spark, b)]
    for bundle in not_imported(spark, ready, root):
        import_bundle(spark, bundle, root, imported_at)
    return sorted(set(found) - set(ready))


def import_stream(spark: SparkSession, arrivals: str, root: str, checkpoint: str, imported_at: str, batch_bundles: int = 100) -> None:
    """Import bundles as their manifests arrive, at most ``batch_bundles`` to a batch.

    A batch looks at the bundles of its own manifests. A manifest is written before the marker, so bundles that are
    not complete yet are noted with the batch and looked at again by the next one, and once more at the end.
    """
    manifests = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", batch_bundles)
        .text(f"{arrivals}/*/manifest.json*")
        .select(F.regexp_replace(F.col("_metadata.file_path"), r"/manifest\.json.*\z", "").alias("bundle"))
    )

    def run(batch: DataFrame, number: int) -> None:
        new = [r.bundle for r in batch.distinct().collect()]
        left = import_arrived(spark, sorted({*new, *_waiting(spark, root, number)}), root, imported_at)
        spark.createDataFrame([(b,) for b in left], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_waiting/batch={number}")

    (
        manifests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    import_arrived(spark, _waiting(spark, root, None), root, imported_at)

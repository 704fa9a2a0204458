"""The two newest observations of every target as keyed state, for tool drift over a stream.

Before the shuffle each task parses an inventory to one digest for each tool and keeps, of an Arrow batch, the two
newest observations of a target. The state of a target is two entries, each its time, its place in the log and the
digests of its tools: no inventory is kept, and a target that fills the stream sends two rows for each batch and task.
Input may come in any order and arbitrarily late, split into batches in any way: the last row emitted for a target
is that of the batch form.

The state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``), which the runners here set.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.documents import compact_text, item_texts
from . import jobs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "target_id string, observed_at string, seq bigint, tools string"
_COUNTS = ("added", "removed", "modified", "unchanged")
CHANGES = StructType(
    [StructField("target_id", StringType()), StructField("latest_at", StringType()), StructField("latest_seq", LongType())]
    + [StructField("previous_at", StringType()), StructField("previous_seq", LongType())]
    + [StructField(c, LongType()) for c in _COUNTS]
)
_STATE = StructType(
    [StructField(f"{name}{k}", kind) for k in (1, 2) for name, kind in (("at", StringType()), ("seq", LongType()), ("tools", StringType()))]
)


def tool_digests(inventory: str | None) -> str:
    """JSON of {tool name: digest of its definition}, the definition as written but for white space."""
    items = item_texts(f'{{"tools":{inventory or "[]"}}}', "tools") or []
    held = {json.loads(t)["name"]: hashlib.blake2b(compact_text(t).encode(), digest_size=16).hexdigest() for t in items}
    return json.dumps(held, sort_keys=True, separators=(",", ":"))


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        newest = jobs._newest_two(batch)
        yield pd.DataFrame(
            {"target_id": newest["target_id"], "observed_at": newest["observed_at"], "seq": newest["seq"], "tools": newest["inventory"].map(tool_digests)}
        )


def change_row(target: str, seen: list[tuple[str, int, str]]) -> dict:
    """The comparison of the one or two newest observations (time, place, digests)."""
    row = {"target_id": target, "latest_at": seen[0][0], "latest_seq": seen[0][1], "previous_at": None, "previous_seq": None, **dict.fromkeys(_COUNTS)}
    if len(seen) > 1:
        new, old = json.loads(seen[0][2]), json.loads(seen[1][2])
        modified = sum(new[k] != old[k] for k in new.keys() & old.keys())
        row |= {
            "previous_at": seen[1][0],
            "previous_seq": seen[1][1],
            "added": len(new.keys() - old.keys()),
            "removed": len(old.keys() - new.keys()),
            "modified": modified,
            "unchanged": len(new.keys() & old.keys()) - modified,
        }
    return row


class NewestTwo(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.held.get() if self.held.exists() else None
        before = [tuple(state[i : i + 3]) for i in (0, 3) if state[i] is not None] if state else []
        seen = before
        for r in rows:
            seen = sorted({*seen, (r.observed_at, r.seq, r.tools)}, key=lambda x: x[:2], reverse=True)[:2]
        if seen != before:
            self.held.update(tuple(x for entry in [*seen, (None, None, None)][:2] for x in entry))
            yield Row(**change_row(key[0], seen))

    def close(self) -> None:
        pass


def newest_two(observations: DataFrame) -> DataFrame:
    """Stream of (target_id, observed_at, seq, inventory) to the changing comparison of the two newest of each target."""
    combined = observations.select("target_id", "observed_at", "seq", "inventory").mapInPandas(_combined, _ENTRY)
    return combined.groupBy("target_id").transformWithState(
        statefulProcessor=NewestTwo(), outputStructType=CHANGES, outputMode="Update", timeMode="None"
    )


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all available input, one output folder per batch."""
    spark: SparkSession = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        jobs.run_to_end(stream, path, checkpoint, "update")
    finally:
        spark.conf.set(name, before)

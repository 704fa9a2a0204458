"""Exact duplicates by a minimal perfect hash over the digests that a history holds.

The distinct digests of the history are dealt into shards of about ``SLOTS``. Each shard is one row of the
index table: a minimal perfect hash function (levels of bit arrays; a digest belongs to the first level in
which no other one has its position, its slot is the rank of that bit), and by slot the full digests with
the locator of the row that stays (its doc_id and its place in the written rows) and the number of copies.

Incoming rows are first folded to distinct digests, so a text that half of all rows repeat is one lookup.
A lookup evaluates the function of its shard and compares all bytes of the slot's digest: equal, and the
incoming rows repeat the history; else they are new, and form a group of their own. What comes out is the
content of the next index.

Digests are SHA-256 of the text in UTF-8 with A-Z in lower case, null counting as empty. Of equal texts the
row with the largest doc_id stays; rows without one stay only among themselves. Of several rows with that
doc_id exactly one stays. An empty history makes all rows new, an empty batch leaves the history as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidemark.session import staged

from .flat import flat, lowered, mix, pieces
from .skew import with_class

SLOTS = 1 << 15  # digests of a shard, on average; the rows of one lookup task are bounded by it too
ROOM = 2.0  # positions of a level for each digest that reaches it


class PerfectHash:
    """Slots 0 to n - 1 for n distinct digests, in about four bits for each."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.levels, at = [], 0
        packed = np.frombuffer(bits, np.uint8)
        base = 0
        for size in sizes:
            length = (size + 7) // 8
            held = np.unpackbits(packed[at : at + length], count=size).astype(bool)
            rank = base + np.cumsum(held) - 1
            self.levels.append((held, rank))
            base, at = base + int(held.sum()), at + length

    @staticmethod
    def positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), 0x9E3779B97F4A7C15 * (level + 1) % (1 << 64), np.uint64)
        for part in keys.T:
            h = mix(h ^ part) + np.uint64(level)
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[list[int], bytes]:
        """(sizes, bits) for distinct keys, rows of 64-bit words."""
        sizes, bits = [], b""
        while len(keys):
            size = max(8, int(ROOM * len(keys)))
            at = cls.positions(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits += np.packbits(alone).tobytes()
            keys = keys[~alone[at]]
        return sizes, bits

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is not in the set some slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (held, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = self.positions(keys[left], level, len(held))
            here = held[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


def _words(digests: pa.Array) -> np.ndarray:
    return flat(digests)[0].view(np.uint64).reshape(len(digests), 4)


def digested(documents: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, the given columns, place, digest) of every row, written once: ``place`` tells rows apart from then on."""
    kept = documents.select("doc_id", "text", *columns)
    named = ["doc_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, offsets = flat(part.column("text"))
                view = memoryview(lowered(data))
                found = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in named), pa.array(found, pa.binary())], [*named, "digest"])

    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in named)
    rows = kept.mapInArrow(run, f"{schema}, digest binary")
    return staged(rows.withColumn("place", F.monotonically_increasing_id()), "digested")


def folded(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_place, rows): the distinct digests of rows, written once because they are counted and used."""
    keep = F.coalesce(F.max_by("place", "doc_id"), F.min("place"))
    found = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), keep.alias("keep_place"), F.count("*").alias("rows"))
    return staged(found, "folded")


def _index_schema(kind: DataType) -> str:
    return f"shard int, sizes array<int>, bits binary, digests binary, keep_id array<{kind.simpleString()}>, keep_place array<long>, rows array<long>"


def indexed(classes: DataFrame) -> DataFrame:
    """The index of distinct digests (digest, keep_id, keep_place, rows): one row for each shard."""
    shards = max(1, -(-classes.count() // SLOTS))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        digests = shard.column("digest").combine_chunks()
        keys = _words(digests)
        sizes, bits = PerfectHash.of(keys)
        order = np.argsort(PerfectHash(sizes, bits).slots(keys))
        slots = [shard.column(c).combine_chunks().take(pa.array(order)) for c in ("keep_id", "keep_place", "rows")]
        row = [
            shard.column("shard").combine_chunks()[:1],
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([bits], pa.binary()),
            pa.array([keys[order].tobytes()], pa.binary()),
            *(pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), s) for s in slots),
        ]
        return pa.table(row, ["shard", "sizes", "bits", "digests", "keep_id", "keep_place", "rows"])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInArrow(build, _index_schema(classes.schema["keep_id"].dataType))
    return staged(index.withColumn("shards", F.lit(shards)), "index")


def merged(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_place, rows, known): the classes of the history and of an incoming batch, put together.

    ``known`` classes are those of the history, with what the batch added to them; the others are new.
    """
    kind = incoming.schema["keep_id"].dataType.simpleString()
    head = index.select("shards").head()
    shards = head.shards if head else 1
    parts = max(1, -(-incoming.count() // (shards * SLOTS)))  # of a shard, where the batch is larger than the history
    names = ["digest", "keep_id", "keep_place", "rows"]

    def marked(rows: pa.Table, known: np.ndarray) -> pa.Table:
        return pa.table([*(rows.column(c) for c in names), pa.array(known, pa.bool_())], [*names, "known"])

    def look_up(shard: pa.Table, batch: pa.Table) -> pa.Table:
        batch = batch.select(names).combine_chunks()
        if not shard.num_rows:
            return marked(batch, np.zeros(batch.num_rows, bool))
        row = {c: shard.column(c)[0] for c in ("sizes", "bits", "digests", *names[1:])}
        own = np.frombuffer(row["digests"].as_py(), np.uint64).reshape(-1, 4)
        digests = pa.array([own[i].tobytes() for i in range(len(own))], pa.binary())
        slots = pa.table([digests, *(row[c].values for c in names[1:])], names)
        if not batch.num_rows:
            found = np.zeros(0, bool)
        else:
            keys = _words(batch.column("digest").combine_chunks())
            at = PerfectHash(row["sizes"].as_py(), row["bits"].as_py()).slots(keys)
            found = (at >= 0) & (own[at] == keys).all(axis=1)  # all bytes of the slot's digest
        out = [marked(batch, found)]
        if not shard.column("part")[0].as_py():  # the slots themselves leave with the first part
            out.append(marked(slots, np.ones(slots.num_rows, bool)))
        return pa.concat_tables(out)

    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    dealt = incoming.select(*names, shard.alias("shard"), F.pmod(F.hash("digest"), F.lit(parts)).alias("part"))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = copies.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(
        look_up, f"digest binary, keep_id {kind}, keep_place long, rows long, known boolean"
    )
    # a known digest comes at most twice: from its slot and from the batch
    keep = F.coalesce(F.max_by("keep_place", "keep_id"), F.min("keep_place"))
    put = found.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), keep.alias("keep_place"), F.sum("rows").alias("rows"), F.max("known").alias("known")
    )
    return staged(put, "classes")


def classified(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``digested`` with their class: keep_id, keep_place, rows, known."""
    return with_class(rows, classes, ["digest"], "rows")


def _put_together(flagged: DataFrame, *columns: str) -> DataFrame:
    rows = digested(flagged, "historical", *columns)
    history, batch = (folded(rows.where(x)) for x in ("historical", "NOT historical"))
    return classified(rows, merged(indexed(history), batch))


def exact_duplicates(documents: DataFrame, historical: Column) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, historical, known) of every row.

    ``historical`` says which rows are the history; the others are the incoming batch (so are those for which it is null).
    """
    flagged = documents.select("doc_id", "text", F.coalesce(historical, F.lit(False)).alias("historical"))
    return _put_together(flagged).select(
        "doc_id",
        "keep_id",
        F.col("rows").alias("group_size"),
        (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "historical",
        "known",
    )


def deduplicated(documents: DataFrame, historical: Column) -> DataFrame:
    """One row, with all its columns, of each group of equal texts."""
    rows = documents.select("doc_id", "text", F.struct("*").alias("row"), F.coalesce(historical, F.lit(False)).alias("historical"))
    kept = _put_together(rows, "row").where(F.col("place") == F.col("keep_place"))
    return kept.select("row.*")

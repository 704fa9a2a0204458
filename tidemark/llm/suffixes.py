"""Removal of byte strings of a given length that occur more than once, over all documents.

The work is that of a difference-cover suffix array, cut down to what equality of ``LENGTH`` bytes
needs:

1. *Sample.* A suffix is sampled where its first ``GRAM`` bytes have the smallest hash of some
   stretch of ``LENGTH`` bytes. The choice depends on content alone, so any two equal strings hold
   a sampled suffix at the same offset, which is what a difference cover is for. About one byte in
   ninety is sampled (a cover by residues samples two in three and would need a row for each).
2. *Names.* The sampled blocks are named (by hash instead of by rank, so that no global order is
   needed) and grouped by name. A name that occurs once starts nothing that repeats.
3. *Recursion.* The remaining samples get the name of their whole surroundings: the bytes from the
   first to the last string that the sample stands for. Equal surroundings count once from here on.
4. *Remaining suffixes.* The strings that start between samples belong to the sample they hold.
   They are merged by (sample name, content), sorted, and neighbours are compared.
5. Repeated starts go back to the texts and the bytes they cover are removed.

From step 3 on, rows with equal texts are one text with a number of copies, which counts for each of its
strings: work and results do not grow with the square of copies. The texts find their rows again at the end,
where a text with a large part of all rows is not shuffled (such a text loses all, so nothing but its name is
broadcast). There is no total order of suffixes: what a suffix array would put next to each other is brought
together by names.

Names shared by more than ``HOT`` samples take the same steps as rows of one string each, added up
by Spark with map-side sums, so that no task receives a hot name whole. Names are two independent
64-bit hashes in every comparison that decides about removal.

A null text counts as empty. Texts shorter than ``LENGTH`` lose nothing. Repeated rows are copies
of each other and lose every string. All bytes of a text are looked at, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

from .flat import Prefix, flat, mix, pieces
from .skew import with_class

LENGTH = 200
GRAM = 32
RUN = 512  # strings one sample stands for at most; a longer run is cut
SEGMENT = 1 << 22
KEYS = ["tag", "twin"]  # two 64-bit hashes of the text, which name it
HOT = 20_000  # surroundings of about 300 bytes each, so that a group is some MB


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the first string, number of strings, name) of every sample, in order of position.

    Consecutive strings that hold the same smallest block, leftmost if it repeats, make one sample.
    """
    starts, counts, names = [], [], []
    width = LENGTH - GRAM + 1
    last = np.repeat(offsets[1:], np.diff(offsets)) - LENGTH  # last string that starts in the row of each byte
    for low in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = data[low : low + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        gram = Prefix(part).windows(GRAM)
        key = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64)
        padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(key)] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.arange(low, low + n) <= last[low : low + n])
        if not len(at):
            continue
        fresh = np.ones(len(at), bool)
        fresh[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.r_[begin, len(at)])
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts.append(at[np.repeat(begin, parts)] + nth * RUN + low)
        counts.append(np.minimum(np.repeat(size, parts) - nth * RUN, RUN))
        names.append(mix(gram[least[at[np.repeat(begin, parts)]]] ^ np.uint64(0xA0761D6478BD642F)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(names)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            name, count = np.unique(samples(*flat(part.column("text")))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(count)], ["name", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            data, offsets = flat(part.column("text"))
            start, count, name = samples(data, offsets)
            row = np.searchsorted(offsets, start, side="right") - 1
            keys = part.select(KEYS).take(pa.array(row))
            at = ((start - offsets[row]) << 16) | count
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *keys.columns, pa.array(at)], ["name", *KEYS, "at"])


class _Stretches:
    """The surroundings of the candidate samples of some texts."""

    def __init__(self, part: pa.RecordBatch):
        self.data, self.offsets = flat(part.column("text"))
        marks = part.column("marks")
        count = np.diff(marks.offsets.to_numpy())
        inner = marks.flatten()
        self.row = np.repeat(np.arange(part.num_rows), count)
        self.at = inner.field("at").to_numpy()
        self.name = inner.field("name").to_numpy()
        self.hot = inner.field("hot").to_numpy(zero_copy_only=False)
        self.start = self.offsets[self.row] + (self.at >> 16)
        self.strings = self.at & 0xFFFF
        self.copies = part.column("copies").to_numpy()[self.row]
        self.prefix = Prefix(self.data)
        self.whole = self.prefix.ranges(self.start, self.start + self.strings + LENGTH - 1).view(np.int64)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, whole, n, bytes) of samples that are not hot; equal ones of a piece are one row."""
    for batch in batches:
        for part in pieces(batch):
            s = _Stretches(part)
            keep = np.flatnonzero(~s.hot)
            if not len(keep):
                continue
            order = keep[np.lexsort((s.whole[keep], s.name[keep]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (s.name[order[1:]] != s.name[order[:-1]]) | (s.whole[order[1:]] != s.whole[order[:-1]])
            first = order[fresh]
            number = np.add.reduceat(s.copies[order], np.flatnonzero(fresh))
            raw = s.data.tobytes()
            text = [raw[a : a + k] for a, k in zip(s.start[first].tolist(), (s.strings[first] + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.name[first]), pa.array(s.whole[first]), pa.array(number), pa.array(text, pa.binary())], ["name", "whole", "n", "bytes"]
            )


def _hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, whole, place, string, n) for every string of hot samples; equal surroundings of a piece are one."""
    for batch in batches:
        for part in pieces(batch):
            s = _Stretches(part)
            keep = np.flatnonzero(s.hot)
            if not len(keep):
                continue
            _, first, same = np.unique(s.whole[keep] ^ mix(s.name[keep].view(np.uint64)).view(np.int64), return_index=True, return_inverse=True)
            number = np.bincount(same, s.copies[keep]).astype(np.int64)
            keep = keep[first]
            size = s.strings[keep]
            of = np.repeat(keep, size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            string = s.prefix.ranges(s.start[of] + place, s.start[of] + place + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.name[of]), pa.array(s.whole[of]), pa.array(place), pa.array(string), pa.array(np.repeat(number, size))],
                ["name", "whole", "place", "string", "n"],
            )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            s = _Stretches(part)
            keys = part.select([*KEYS, "copies"]).take(pa.array(s.row))
            yield pa.RecordBatch.from_arrays([pa.array(s.name), pa.array(s.whole), *keys.columns, pa.array(s.at)], ["name", "whole", *KEYS, "copies", "at"])


def _compared(name: np.ndarray, whole: np.ndarray, number: np.ndarray, column: pa.Array) -> pa.RecordBatch:
    """Repeated strings of complete groups of one name, as runs (place << 16 | count) within each surroundings."""
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(fresh)
    number = np.add.reduceat(number, first)
    name, whole = name[first], whole[first]
    data, offsets = flat(column.take(pa.array(first)))
    size = np.diff(offsets) - LENGTH + 1
    of = np.repeat(np.arange(len(first)), size)
    base = np.cumsum(size) - size
    start = np.arange(len(of)) - base[of] + offsets[of]
    prefix = Prefix(data)
    key = mix((prefix.ranges(start, start + LENGTH)) ^ mix(name.view(np.uint64))[of])
    order = np.argsort(key)
    ranked = key[order]
    named = name[of[order]]
    equal = (ranked[1:] == ranked[:-1]) & (named[1:] == named[:-1])  # neighbours in sorted order
    twice = number[of] > 1
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.ones(len(of), bool)
    edge[1:] = of[1:] != of[:-1]
    begin = twice.copy()
    begin[1:] &= ~twice[:-1] | edge[1:]
    end = twice.copy()
    end[:-1] &= ~twice[1:] | edge[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    runs = ((begin - base[of[begin]]) << 16) | (end - begin + 1)
    per = np.bincount(of[begin], minlength=len(first))
    some = np.flatnonzero(per)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per[some])], pa.int32()), pa.array(runs))
    return pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(whole[some]), lists], ["name", "whole", "runs"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        for part in pieces(batch, "bytes", 4 << 20):
            both = pa.Table.from_batches([part])
            if held is not None:
                both = pa.concat_tables([held, both])
            name = both.column("name").to_numpy()
            open_ = int(np.searchsorted(name, name[-1]))
            if open_:
                yield _compared_table(both.slice(0, open_))
            held = both.slice(open_)
    if held is not None and held.num_rows:
        yield _compared_table(held)


def _compared_table(t: pa.Table) -> pa.RecordBatch:
    return _compared(t.column("name").to_numpy(), t.column("whole").to_numpy(), t.column("n").to_numpy(), t.column("bytes").combine_chunks())


def _merged_spans(runs: list[tuple[int, int]]) -> list[list[int]]:
    """The maximal [start, stop) byte ranges that repeated strings (start, number of starts) cover."""
    spans: list[list[int]] = []
    for start, count in sorted(runs):
        stop = start + count - 1 + LENGTH
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    return spans


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            _merged_spans([((h["at"] >> 16) + (r >> 16), r & 0xFFFF) for h in hits for r in h["runs"]]) for hits in batch.column("hits").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*KEYS, "copies"]), pa.array(out, pa.list_(pa.list_(pa.int64())))], [*KEYS, "copies", "spans"])


def _cut(data: bytes, spans: list[list[int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]])


def _rest(part: pa.RecordBatch) -> list[bytes]:
    """What is left of each text; a row without spans keeps all."""
    return [_cut((t or "").encode(), s or []) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            found = [hashlib.sha256(k).hexdigest() for k in _rest(part)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), pa.array(found, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _named(text: str = "text") -> list[Column]:
    filled = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(filled).alias("tag"), F.xxhash64(F.lit(1), filled).alias("twin")]


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(tag, twin, copies, spans) of the distinct texts that lose something, written once.

    ``tag`` and ``twin`` (``xxhash64(text)``, ``xxhash64(1, text)``) name the text, ``copies`` is its number of rows,
    ``spans`` are the removed [start, stop) byte ranges.
    """
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") >= LENGTH).select("text", *_named())
    name_counts = texts.select("text").mapInArrow(_names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    shared = staged(name_counts.select("name", (F.col("n") > HOT).alias("hot")), "names")
    places = texts.mapInArrow(_places, "name long, tag long, twin long, at long").join(shared, "name")
    # a set, since copies of a text bring the same marks; bounded by the text
    marks = places.groupBy(*KEYS).agg(F.collect_set(F.struct("at", "name", "hot")).alias("marks"))
    distinct = texts.groupBy(*KEYS).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    marked = staged(distinct.join(marks, KEYS).select(*KEYS, "copies", "text", "marks"), "marked")

    near = marked.mapInArrow(_surroundings, "name long, whole long, n long, bytes binary")
    runs = near.repartition("name").sortWithinPartitions("name", "whole").mapInArrow(_merged, "name long, whole long, runs array<long>")
    if not shared.where("hot").isEmpty():
        strings = staged(marked.mapInArrow(_hot_strings, "name long, whole long, place long, string long, n long"), "strings")
        repeated = strings.groupBy("name", "string").agg(F.sum("n").alias("n")).where("n > 1").select("name", "string")
        hot = strings.select("name", "whole", "place", "string").join(repeated, ["name", "string"]).groupBy("name", "whole")
        hot = hot.agg(F.transform(F.collect_set("place"), lambda p: p * 65536 + 1).alias("runs"))  # RUN strings at most
        runs = runs.unionByName(hot)
    members = marked.mapInArrow(_members, "name long, whole long, tag long, twin long, copies long, at long")
    hits = members.join(runs, ["name", "whole"]).groupBy(*KEYS).agg(F.max("copies").alias("copies"), F.collect_list(F.struct("at", "runs")).alias("hits"))
    return staged(hits.mapInArrow(_spans, "tag long, twin long, copies long, spans array<array<long>>"), "spans")


def removal_report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = documents.select("doc_id", "text", *_named())
    both = with_class(rows, repeated_spans(documents), KEYS, "copies", "left").select(
        "doc_id",
        "text",
        "spans",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0]), F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, their text less the repeated strings (``n_chars`` follows, if present).

    A character cut in two goes as a whole.
    """
    columns = documents.columns
    rows = documents.select(F.struct("*").alias("row"), *_named())
    both = with_class(rows, repeated_spans(documents), KEYS, "copies", "left").select("row.text", "spans", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                text = [k.decode("utf-8", "ignore") if s else t for k, s, t in zip(_rest(part), part.column("spans").to_pylist(), part.column("text").to_pylist())]
                row = part.column("row")
                fields = [pa.array(text, pa.string()) if c == "text" else row.field(k) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(fields, columns)

    out = both.mapInArrow(cut, documents.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out

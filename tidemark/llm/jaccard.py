"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share.

1. Every document becomes the set of its distinct shingles (64-bit hashes). Documents with equal
   sets form one class; from then on a class counts once, whatever its number of copies.
2. A table of ``SKETCH`` counters over all shingles of all documents gives one global order, rare
   shingles first. Its size is fixed; where counters collide the order gets less good, never wrong.
3. In that order two sets can only link if they share a shingle among the first
   ``n - ceil(0.8 n) + 1``. Sets of compatible size that share such a shingle are chained, first
   within each task, then by one shuffle on the shingle; components of the chains hold every
   possible link. A component too large for one task is taken apart once more with the exact
   counts of its own shingles as order, which leaves out chains through shared passages.
4. The sets of a component meet in one task, or in blocks of about ``BLOCK`` sets and
   ``BLOCK_SHINGLES`` shingles if it is larger.
   There they are stored in a prefix tree (most shared shingles first, so that near copies share
   long paths). Each set walks the tree once: a path's overlap is counted once for all sets below
   it, and a subtree is left as soon as the remaining lengths or set sizes rule a link out, or all
   its sets are already known to be connected with the walker.
5. Sets of one component in different blocks that are not connected by then are compared by pairs
   of blocks in the same way. Nothing is capped: every link is either walked or implied.

Texts without words (null and empty ones too) have no shingles and link with nothing. A shorter
text is one shingle. Repeated rows count as copies of one another, also under one doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

from .components import components
from .flat import WHITE, flat, grouped, lowered, mix, pieces, words

SHINGLE = 5
SKETCH_BITS = 22
SLICES = 64  # of the sketch: so many tasks can add it up
BLOCK = 512
BLOCK_SHINGLES = 500_000
PIVOTS = 16
FLUSH = 2_000_000
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C13, k + 1, 1 << 64)) for k in range(SHINGLE)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    w = words(lowered(data), offsets, WHITE)
    n = len(w.hash)
    rolled = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += w.hash[k : k + len(rolled)] * _STEPS[k]
    rolled = mix(rolled)
    first = w.first.tolist()
    sets = []
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= SHINGLE:
            found = np.sort(rolled[low : high - SHINGLE + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            sets.append(found[fresh])
        elif high > low:
            whole = sum((int(h) * int(s) for h, s in zip(w.hash[low:high], _STEPS)), high - low)
            sets.append(mix(np.array([whole & (2**64 - 1)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((2, len(sets)), np.uint64)
    if sizes.sum():
        every = np.concatenate(sets)
        at = np.flatnonzero(sizes)
        start = (np.cumsum(sizes) - sizes)[at]
        for k, seed in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
            out[k, at] = mix(np.add.reduceat(mix(every ^ np.uint64(seed)), start))
    return out[0].view(np.int64), out[1].view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, tag, n, hi, lo) for each document, then the task's counters in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for part in pieces(batch):
            sets = shingles(*flat(part.column("text")))
            high, low = digests(sets)
            if len(sets):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(low), none.cast(pa.int32()), none.cast(pa.binary())],
                ["doc_id", "tag", "n", "hi", "lo", "slice", "counts"],
            )
    if counts.any():
        cut = counts.astype(np.uint32).reshape(SLICES, -1)
        none = pa.nulls(SLICES)
        yield pa.RecordBatch.from_arrays(
            [none.cast(kind), *[none.cast(pa.int64())] * 4, pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in cut], pa.binary())],
            ["doc_id", "tag", "n", "hi", "lo", "slice", "counts"],
        )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.int64)
            total[at] = total.get(at, 0) + part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["slice", "counts"]
        )


def sketch(profile: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: 2**SKETCH_BITS numbers, whatever the input, in steps of their mean at least."""
    slices = profile.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for row in slices.mapInArrow(_added, "slice int, counts binary").collect():
        counts[row.slice] = np.frombuffer(row.counts, np.uint32)
    whole = counts.ravel()
    return np.minimum(whole // max(1, int(whole.mean()) >> 10), 0xFFFF).astype(np.uint16)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def _chained(token: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (token, low): (whether a row continues the one before, largest size so far in its run of tokens)."""
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    segment = np.cumsum(~same)
    top = np.maximum.accumulate((segment << 40) | high) & ((1 << 40) - 1)
    joined = same.copy()
    joined[1:] &= 5 * top[:-1] >= 4 * low[1:]
    return joined, top


def _postings(counts: np.ndarray):
    """Rows (token, a, size): a set that has the token in its prefix (size: smallest << 32 | largest of the sets it
    stands for), or an edge between the sets ``a`` and ``token`` (size: -1)."""

    def flushed(token, ids, sizes) -> Iterator[pa.RecordBatch]:
        token, ids, sizes = np.concatenate(token), np.concatenate(ids), np.concatenate(sizes)
        order = np.lexsort((ids, sizes, token))
        token, ids, sizes = token[order], ids[order], sizes[order]
        joined, _ = _chained(token, sizes, sizes)
        to = np.flatnonzero(joined & (ids != np.roll(ids, 1)))
        edges = np.unique(np.stack([ids[to - 1], ids[to]], axis=1), axis=0) if len(to) else np.zeros((0, 2), np.int64)
        start = np.flatnonzero(~joined)
        last = np.r_[start[1:], len(token)] - 1
        size = np.r_[(sizes[start] << 32) | sizes[last], np.full(len(edges), -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[token[start], edges[:, 1]]), pa.array(np.r_[ids[start], edges[:, 0]]), pa.array(size)], ["token", "a", "size"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids, sizes, held = [], [], [], 0
        for batch in batches:
            for part in pieces(batch):
                sets = shingles(*flat(part.column("text")))
                _, name = digests(sets)
                for s, own in zip(sets, name):
                    if not len(s):
                        continue
                    take = int(prefix_length(np.int64(len(s))))
                    rank = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    if take < len(s):
                        cut = np.partition(rank, take - 1)[take - 1]
                        sure, tied = s[rank < cut], s[rank == cut]  # both in order of the hash
                        chosen = np.concatenate([sure, tied[: take - len(sure)]])
                    else:
                        chosen = s
                    token.append(chosen.view(np.int64))
                    ids.append(np.full(take, own))
                    sizes.append(np.full(take, len(s), np.int64))
                    held += take
                if held >= FLUSH:
                    yield from flushed(token, ids, sizes)
                    token, ids, sizes, held = [], [], [], 0
        if held:
            yield from flushed(token, ids, sizes)

    return run


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between neighbours of compatible size under one token; rows that are edges already pass."""
    carry = None
    for batch in batches:
        token, a, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "a", "size"))
        edge = size < 0
        out_a, out_b = a[edge], token[edge]
        token, a, low, high = token[~edge], a[~edge], size[~edge] >> 32, size[~edge] & 0xFFFFFFFF
        if len(token):
            if carry is not None:
                token, a, low, high = (np.r_[np.array([c], x.dtype), x] for c, x in zip(carry, (token, a, low, high)))
            joined, top = _chained(token, low, high)
            to = np.flatnonzero(joined)
            to = to[a[to] != a[to - 1]]
            out_a, out_b = np.r_[out_a, a[to - 1]], np.r_[out_b, a[to]]
            carry = (token[-1], a[-1], low[-1], top[-1])
        yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b)], ["a", "b"])


class _Node:
    __slots__ = ("segment", "children", "sets", "least", "most", "below", "one", "uniform")

    def __init__(self, segment: np.ndarray):
        self.segment, self.children, self.sets = segment, {}, []
        self.least, self.most, self.below = 1 << 60, 0, 0
        self.one, self.uniform = -1, True


class PrefixTree:
    """Sets of ranks in a path-compressed trie, with links found by walking it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], label: list[int] | None = None):
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, at, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts > 1
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        self.width = int(shared.sum())  # shared values have the lowest ranks
        bounds = np.cumsum([0, *map(len, sets)])
        self.paths = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            own = np.sort(rank[at[low:high]])
            self.paths.append(own[: np.searchsorted(own, self.width)])
        self.sizes = sizes
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.root = _Node(np.zeros(0, np.int64))
        if label is not None:
            seen: dict[int, int] = {}
            for i, x in enumerate(label):
                self.parent[i] = seen.setdefault(x, i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def insert(self, i: int) -> None:
        path, size, own, node, at = self.paths[i], self.sizes[i], self.find(i), self.root, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.one < 0:
                node.one = i
            elif node.uniform and self.find(node.one) != own:
                node.uniform = False
            node.below = max(node.below, len(path) - at)
            if at == len(path):
                node.sets.append(i)
                return
            child = node.children.get(int(path[at]))
            if child is None:
                child = node.children[int(path[at])] = _Node(path[at:])
                at = len(path)
            else:
                span = min(len(child.segment), len(path) - at)
                differs = np.flatnonzero(child.segment[:span] != path[at : at + span])
                same = int(differs[0]) if len(differs) else span
                if same < len(child.segment):
                    upper = _Node(child.segment[:same])
                    upper.least, upper.most, upper.one, upper.uniform = child.least, child.most, child.one, child.uniform
                    upper.below = child.below + len(child.segment) - same
                    child.segment = child.segment[same:]
                    upper.children[int(child.segment[0])] = child
                    node.children[int(path[at])] = child = upper
                at += same
            node = child

    def walk(self, i: int) -> None:
        """Link set i with the sets in the tree that it overlaps enough and is not connected with yet."""
        path, size = self.paths[i], self.sizes[i]
        held = np.zeros(self.width, bool)
        held[path] = True
        stack = [(self.root, 0, len(path))]
        while stack:
            node, overlap, left = stack.pop()
            if node.uniform and node.one >= 0 and self.find(node.one) == self.find(i):
                continue
            if 5 * node.most < 4 * size or 5 * size < 4 * node.least:
                continue
            if len(node.segment):
                gained = int(np.count_nonzero(held[node.segment]))
                overlap += gained
                left = len(path) - int(np.searchsorted(path, node.segment[-1], side="right"))
            smallest = max(node.least, (4 * size + 4) // 5)
            if 9 * (overlap + min(left, node.below)) < 4 * (size + smallest):
                continue
            for j in node.sets:
                if 9 * overlap >= 4 * (size + self.sizes[j]) and self.find(i) != self.find(j):
                    self.links.append((i, j))
                    self.parent[self.find(i)] = self.find(j)
            stack += [(c, overlap, left) for c in node.children.values() if not held[c.segment[0]]]
            stack += [(c, overlap, left) for c in node.children.values() if held[c.segment[0]]]


def linked(sets: list[np.ndarray], sizes: list[int]) -> list[tuple[int, int]]:
    """Links that connect every two sets of a group that a chain of links connects."""
    tree = PrefixTree(sets, sizes)
    for i in sorted(range(len(sets)), key=sizes.__getitem__):
        tree.walk(i)
        tree.insert(i)
    return tree.links


def linked_across(sets: list[np.ndarray], sizes: list[int], label: list[int], second: list[bool]) -> list[tuple[int, int]]:
    """The same between sets of two blocks, of which those with equal labels are known to be connected."""
    tree = PrefixTree(sets, sizes, label)
    for i in range(len(sets)):
        if not second[i]:
            tree.insert(i)
    for i in range(len(sets)):
        if second[i]:
            tree.walk(i)
    return tree.links


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, blocks, sets, rep, tokens) of texts whose digest is the wanted one; ``lo`` names the set from here on."""
    for batch in batches:
        for part in pieces(batch):
            sets = shingles(*flat(part.column("text")))
            high, low = digests(sets)
            same = (high == part.column("hi").to_numpy()) & (low == part.column("lo").to_numpy())
            at = np.flatnonzero(same)
            kept = part.take(pa.array(at))
            tokens = pa.array([sets[i].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("comp", "blocks", "sets", "lo")), tokens], ["comp", "blocks", "sets", "rep", "tokens"])


def _joined(across: bool):
    keys = ["comp", "block", "other"] if across else ["comp", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            rep = group.column("rep").to_numpy()
            _, first = np.unique(rep, return_index=True)  # repeated rows of one set
            group, rep = group.take(pa.array(first)), rep[first]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("tokens")]
            sizes = [len(s) for s in sets]
            if across:
                links = linked_across(sets, sizes, group.column("label").to_pylist(), group.column("second").to_pylist())
            else:
                links = linked(sets, sizes)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(rep[[i for i, _ in links]]), pa.array(rep[[j for _, j in links]])], ["a", "b"])

    return run


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile of every document, classes of equal sets with their smallest doc_id, links between these by ``lo``).

    The links are enough to connect everything that links connect, they are not all links.
    """
    texts = documents.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    tagged = texts.withColumn("tag", F.xxhash64("text"))
    profile = staged(tagged.mapInArrow(_profile, f"doc_id {kind}, tag long, n long, hi long, lo long, slice int, counts binary"), "sets")
    counts = sketch(profile)
    docs = profile.where("slice IS NULL").select("doc_id", "tag", "n", "hi", "lo")
    reps = docs.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))

    postings = texts.mapInArrow(_postings(counts), "token long, a long, size long")
    near = components(_chains(postings)).select(F.col("node").alias("lo"), F.col("root").alias("comp"))
    wanted = reps.where("rep IS NOT NULL").join(near, "lo")
    sets = texts.join(_blocks(wanted).withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "hi", "lo", "comp", "blocks", "sets")
    sets = staged(sets.mapInArrow(_sets_of, "comp long, blocks int, sets long, rep long, tokens binary"), "shingles")
    small, large = sets.where("blocks = 1"), sets.where("blocks > 1")
    if large.isEmpty():
        return docs, reps, _apply(small.withColumn("block", F.lit(0)), ["comp", "block"], False)
    large = _taken_apart(large)
    sets = small.unionByName(large).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(1)), F.col("sets")) < PIVOTS)
    everywhere = sets.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = _apply(everywhere, ["comp", "block"], False)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return docs, reps, links
    links = staged(links, "links")
    label = components(links).select(F.col("node").alias("rep"), F.col("root").alias("label"))
    large = large.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = large.groupBy("comp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("comp")
    large = large.join(open_, "comp", "left_semi")
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with <> block")
    pairs = large.select(
        "comp", F.least("block", "with").alias("block"), F.greatest("block", "with").alias("other"), (F.col("block") > F.col("with")).alias("second"), "rep", "label", "tokens"
    )
    return docs, reps, links.unionByName(_apply(pairs, ["comp", "block", "other"], True))


def _chains(postings: DataFrame) -> DataFrame:
    return postings.repartition("token").sortWithinPartitions("token", "size").mapInArrow(_swept, "a long, b long")


def _blocks(wanted: DataFrame) -> DataFrame:
    """Adds ``sets`` and ``blocks`` of each component; components of one set go. ``n`` is the size of a set."""
    size = wanted.groupBy("comp").agg(F.count("rep").alias("sets"), F.sum("n").alias("total")).where("sets > 1")
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    return wanted.join(size.select("comp", "sets", blocks.alias("blocks")), "comp")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "tokens"):
            data, offsets = flat(part.column("tokens"))
            sizes = np.diff(offsets) // 8
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(row)), pa.array(data.view(np.int64)), pa.array(sizes[row])], ["rep", "token", "n"])


def _taken_apart(large: DataFrame) -> DataFrame:
    """The sets of large components with new components, from prefixes in the order of exact shingle counts among them."""
    rows = large.select("rep", "tokens").mapInArrow(_unpacked, "rep long, token long, n long")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(counts, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))  # a set each
    # shingles of one set only come first in the order: they use up the prefix and link with nothing
    length = F.size("held") - F.expr("(4 * n + 4) div 5") + 1
    prefix = shared.where(length > 0).select(F.xxhash64("rep").alias("a"), "n", F.explode(F.slice("held", 1, length.cast("int"))).alias("x"))
    near = components(_chains(prefix.select(F.col("x.token").alias("token"), "a", (F.shiftleft("n", 32) + F.col("n")).alias("size"))))
    named = large.withColumn("node", F.xxhash64("rep")).drop("comp", "blocks", "sets").join(near.withColumnRenamed("root", "comp"), "node").drop("node")
    sized = _blocks(named.withColumn("n", F.octet_length("tokens") / 8)).drop("n")
    return staged(sized.select("comp", "blocks", "sets", "rep", "tokens"), "parts")


def _apply(sets: DataFrame, keys: list[str], across: bool) -> DataFrame:
    return sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joined(across), "a long, b long")


def _labelled(documents: DataFrame) -> DataFrame:
    """(doc_id, tag, hi, lo, n_shingles, component_id) of every row; ``tag`` is a hash of the text."""
    docs, reps, links = classes(documents)
    nodes = components(links).withColumnRenamed("node", "lo")
    least = nodes.join(reps.where("rep IS NOT NULL").select("lo", "rep"), "lo").groupBy("root").agg(F.min("rep").alias("component"))
    named = reps.join(nodes.join(least, "root").select("lo", "component"), "lo", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    return docs.join(named, ["hi", "lo"], "left").select(
        "doc_id",
        "tag",
        "hi",
        "lo",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links lead to."""
    return _labelled(documents).select("doc_id", "n_shingles", "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, without those that link (through others) to a smaller doc_id.

    Documents without shingles all stay, and so do rows with a null doc_id, unless a row with a doc_id has
    the same shingles. Of rows that repeat one doc_id and its shingles one stays; different texts of one
    doc_id are different documents.
    """
    found = staged(_labelled(documents.select("doc_id", "text")), "near")
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    kept = found.where("doc_id <=> component_id").withColumn("own", F.when(stays, F.col("tag")))
    kept = kept.groupBy("doc_id", "hi", "lo", "own").agg(F.min("tag").alias("tag"))
    id_ = F.coalesce("doc_id", F.lit(0).cast(documents.schema["doc_id"].dataType)).alias("id")
    keys = [id_, F.col("doc_id").isNull().alias("none")]  # equal keys, so that the join and the ranks share a shuffle
    rows = documents.select(F.struct("*").alias("row"), *keys, F.xxhash64("text").alias("tag"))
    rows = rows.join(kept.select(*keys, "tag", F.col("own").isNotNull().alias("stays")), ["id", "none", "tag"])
    each = F.when(F.col("stays"), F.monotonically_increasing_id()).otherwise(-1)
    nth = F.row_number().over(Window.partitionBy("id", "none", "tag", "each").orderBy("tag"))
    return rows.withColumn("each", each).withColumn("nth", nth).where("nth = 1").select("row.*")

"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine ``c`` lie at squared distance ``2 - 2c``. After a fixed rotation, which
spreads the differences over all coordinates, the vectors are split into ``BLOCKS`` subspaces; in at
least one of them a near pair stays within its share of that squared distance. So each subspace is
range-joined on its own under that radius:

* A grid over its first coordinates has cells of twice the radius. A vector goes to every cell that a
  box of half the radius around it touches, so any pair within the radius meets in the cell of its
  midpoint (and is taken there alone). The number of grid coordinates follows from the number of
  vectors, so that cells stay small; it never changes what is found.
* In a cell all pairs within the block radius are verified exactly, with the cosine of the original
  vectors in double precision. A pair that several blocks find counts in the first of them.
* A cell of more than ``CELL`` vectors is compared in pairs of parts, each a task's work.

Exact copies (equal label and vector) are one class from the start and count by their number, so a
group of copies costs as much as one vector. Cells emit link counts and a spanning forest, not pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows
with a null label; only vectors of one length are compared. Repeated rows are copies: they link with each
other. A null vec_id takes part in counts, but names no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import staged

from .components import components, forest
from .flat import grouped

COSINE = 0.98
BLOCKS = 4
CELL = 4000
ROWS = 512  # of a cell that are compared with the others at once
FILL = 1000  # vectors of one label that a cell should hold on average
SLACK = 1e-9
SEED = 11
CELL_KEYS = ["cell", "block", "part", "other", "label", "dim"]


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]


def blocks_of(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rotated(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ rotation(vectors.shape[1])


def _radius(cosine: float, blocks: int) -> float:
    return math.sqrt((2 - 2 * cosine) / blocks + SLACK)


def _cell_names(cells: np.ndarray, block: int) -> np.ndarray:
    """One 64-bit number for each row of grid coordinates; equal names of other cells only cost time."""
    h = np.full(len(cells), (block + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1, np.uint64)
    for c in cells.T:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _placed(grid: int, cosine: float):
    """(cell, block, class columns) for every cell that a vector belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                turned = rotated(matrix(part.column("embedding")))
                cuts = blocks_of(int(dim))
                radius = _radius(cosine, len(cuts))
                for b, (low, high) in enumerate(cuts):
                    at = turned[:, low : min(high, low + grid)]
                    near, far = np.floor((at - radius / 2) / (2 * radius)), np.floor((at + radius / 2) / (2 * radius))
                    rows, cells = np.arange(len(at)), near
                    for k in range(at.shape[1]):  # both cells of each coordinate whose box crosses a border
                        more = np.flatnonzero(far[rows, k] != near[rows, k])
                        other = cells[more].copy()
                        other[:, k] = far[rows[more], k]
                        rows, cells = np.r_[rows, rows[more]], np.vstack([cells, other])
                    kept = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_cell_names(cells, b)), pa.array(np.full(len(rows), b, np.int32)), *kept.columns], ["cell", "block", *kept.schema.names]
                    )

    return run


def near_pairs(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, cell: int, grid: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that are near, whose midpoint lies in the cell, and that no earlier block has."""
    turned = rotated(vectors)
    cuts = blocks_of(vectors.shape[1])
    radius = _radius(cosine, len(cuts))
    low, high = cuts[block]
    own = turned[:, low:high]
    square = (own**2).sum(axis=1)
    close_i, close_j = [], []
    for s in range(0, len(left), ROWS):
        some = left[s : s + ROWS]
        apart = square[some][:, None] + square[right][None, :] - 2 * own[some] @ own[right].T
        i, j = np.nonzero(apart <= radius**2 + 1e-7)
        close_i.append(some[i])
        close_j.append(right[j])
    i, j = np.concatenate(close_i or [left[:0]]), np.concatenate(close_j or [left[:0]])
    one = i != j
    i, j = i[one], j[one]
    if not len(i):
        return i, j
    norm = np.linalg.norm(vectors, axis=1)
    found_i, found_j = [], []
    for s in range(0, len(i), 200_000):
        a, b = i[s : s + 200_000], j[s : s + 200_000]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= cosine
        a, b = a[near], b[near]
        gaps = (turned[a] - turned[b]) ** 2
        first = np.full(len(a), -1)
        for k in range(len(cuts) - 1, -1, -1):
            first[gaps[:, cuts[k][0] : cuts[k][1]].sum(axis=1) <= radius**2] = k
        middle = np.floor((turned[a, low : min(high, low + grid)] + turned[b, low : min(high, low + grid)]) / 2 / (2 * radius))
        keep = (first == block) & (_cell_names(middle, block) == cell)
        found_i.append(a[keep])
        found_j.append(b[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _verified(grid: int, cosine: float, kind: pa.DataType):
    """Rows (rep, links, null) with link counts and (rep, null, root) with a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, CELL_KEYS):
            group = group.take(pa.array(np.unique(group.column("rep").to_numpy(), return_index=True)[1]))  # two cells of one name
            rep, number = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            vectors = matrix(group.column("embedding").combine_chunks())
            own = group.column("own").to_numpy()
            part, other = group.column("part")[0].as_py(), group.column("other")[0].as_py()
            left = np.flatnonzero(own == part)
            right = np.flatnonzero(own == other)
            i, j = near_pairs(vectors, left, right, group.column("block")[0].as_py(), group.column("cell")[0].as_py(), grid, cosine)
            if part == other:
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            links = np.bincount(np.r_[i, j], np.r_[number[j], number[i]], len(rep)).astype(np.int64)
            some = np.flatnonzero(links)
            tree = forest(list(zip(rep[i].tolist(), rep[j].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(rep[some], kind), pa.array([x for x, _ in tree], kind)]),
                    pa.concat_arrays([pa.array(links[some]), pa.nulls(len(tree), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(some), kind), pa.array([y for _, y in tree], kind)]),
                ],
                ["rep", "links", "root"],
            )

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    good = (
        F.col("embedding").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    named = embeddings.select(
        "vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"), F.xxhash64("embedding", F.lit(1)).alias("hi"), F.xxhash64("embedding", F.lit(2)).alias("lo")
    )
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    classes = named.where("good AND vec_id IS NOT NULL").groupBy("label", "hi", "lo").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nulls = named.where("good AND vec_id IS NULL").groupBy("label", "hi", "lo").agg(F.count(F.lit(1)).alias("unnamed"))
    classes = staged(classes.join(nulls, ["label", "hi", "lo"], "left").withColumn("copies", F.col("copies") + F.coalesce("unnamed", F.lit(0))).drop("unnamed"), "classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    grid = max(1, math.ceil(math.log(max(1, most / FILL), 2.5)))  # a coordinate divides a cell by 2.5 or more

    vectors = named.where("good").select("vec_id", "label", "hi", "lo", "embedding")
    kept = classes.select("label", "hi", "lo", "copies", F.col("rep").alias("vec_id"))
    reps = vectors.join(kept, ["label", "hi", "lo", "vec_id"]).dropDuplicates(["label", "hi", "lo"])
    reps = staged(reps.select(F.col("vec_id").alias("rep"), "label", "copies", F.size("embedding").alias("dim"), "embedding"), "vectors")
    array = embeddings.schema["embedding"].dataType.simpleString()
    label = embeddings.schema["label"].dataType.simpleString()
    cells = reps.mapInArrow(_placed(grid, cosine), f"cell long, block int, rep {kind}, label {label}, copies long, dim int, embedding {array}")
    # placed once to be counted and once to be dealt out: cheaper than keeping the copies of the vectors
    key = ["cell", "block", "label", "dim"]
    full = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    full = full.select(*key, F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    parted = cells.join(full, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    parted = parted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = parted.select("*", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other")).drop("with", "parts")
    arrow_kind = to_arrow_type(embeddings.schema["vec_id"].dataType)
    found = pairs.repartition(*CELL_KEYS).sortWithinPartitions(*CELL_KEYS).mapInArrow(_verified(grid, cosine, arrow_kind), f"rep {kind}, links long, root {kind}")
    found = staged(found, "found")
    links = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("root IS NOT NULL").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(roots, "rep", "left").select(
        "label", "hi", "lo", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("component")
    )
    rows = named.select("vec_id", "hi", "lo", F.when(F.col("good"), F.col("label")).alias("label"))
    return rows.join(known, ["label", "hi", "lo"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

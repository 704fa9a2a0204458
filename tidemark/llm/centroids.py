"""Centroid clustering with an incremental distance matrix, in whole numbers.

A vector becomes whole numbers, floor(scale * component). With each vector its dot products with all
centroids are kept, exactly. When the centroids move, only the components that changed are multiplied: the
dot product of a vector and a centroid grows by the sum of x[j] * change[j] over the centroid's changed j.
A centroid that stays costs nothing. The squared distance is |x|² - 2 x·c + |c|²; |x|² is kept as well.

Each round is one written table (vector, dot products, cluster), read from the one before, which is then
deleted: a lost executor costs a re-read of one round. Sums by cluster are combined in each task before
they meet, k rows of sums from a task; only k * dim numbers reach the driver.

Vectors that are null, of another length, or with a null or non-finite component are left out. Repeated
rows are vectors of their own. A null vec_id is a vector as any other, the last to become a first centroid.
Fewer vectors than centroids give as many centroids as vectors; an empty table gives no rows. All sums must
fit 64 bits: a component beyond ``LARGEST`` in size is an error that names the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.session import remove, staged

LARGEST = 1 << 26  # 64 components of twice that, squared, stay below 2**63


def whole_numbers(embeddings: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x, hash): x holds ``dim`` 32-bit numbers, floor(scale * component), of every vector that takes part."""
    kind = embeddings.schema["vec_id"].dataType
    numbered = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            starts = column.offsets.to_numpy()
            sizes = np.diff(starts)
            good = np.flatnonzero((sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False))
            values = column.values.to_numpy(zero_copy_only=False)  # a null is nan
            x = values[starts[:-1][good][:, None] + np.arange(dim)]
            finite = np.isfinite(x).all(axis=1)
            good, x = good[finite], np.floor(scale * x[finite])
            large = np.flatnonzero((np.abs(x) > LARGEST).any(axis=1))
            if len(large):
                raise OverflowError(f"a component of vector {batch.column('vec_id')[int(good[large[0]])]} is beyond {LARGEST} / {scale}")
            rows = x.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(good)), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "x"]
            )

    return numbered.mapInArrow(run, f"vec_id {kind.simpleString()}, x binary")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of "seed:vec_id"; ties by the numbers themselves."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    least = vectors.select(name.alias("name"), F.hex("x").alias("x")).orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()
    return np.array([np.frombuffer(bytes.fromhex(r.x), "<i4") for r in least], np.int64)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def nearest(dots: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance); of equal distances the smaller cluster."""
    distance = norms[:, None] - 2 * dots + (centroids**2).sum(axis=1)[None, :]
    cluster = distance.argmin(axis=1)
    return cluster.astype(np.int32), distance[np.arange(len(dots)), cluster]


def assigned(state: DataFrame, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """(vec_id, x, norm, dots, cluster, distance): the next state, its dot products brought up to date by what changed.

    ``state`` has (vec_id, x) where there are no dot products yet, and else what this function returned.
    """
    kind = state.schema["vec_id"].dataType
    moved = [(k, np.flatnonzero(c)) for k, c in enumerate(now - before) if c.any()] if before is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), "<i4").astype(np.int64)
            if moved is None:
                norms, dots = (x**2).sum(axis=1), x @ now.T
            else:
                norms, dots = batch.column("norm").to_numpy(), _matrix(batch.column("dots"), "<i8").copy()
                for k, parts in moved:
                    dots[:, k] += x[:, parts] @ (now - before)[k, parts]
            cluster, distance = nearest(dots, norms, now)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(norms), pa.array([d.tobytes() for d in dots], pa.binary()), pa.array(cluster), pa.array(distance)],
                ["vec_id", "x", "norm", "dots", "cluster", "distance"],
            )

    return state.mapInArrow(run, f"vec_id {kind.simpleString()}, x binary, norm long, dots binary, cluster int, distance long")


def moved_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of every cluster that has vectors; the others stay."""
    k, dim = now.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x, cluster = _matrix(batch.column("x"), "<i4"), batch.column("cluster").to_numpy()
            for c in range(k):
                own = x[cluster == c]
                total[c, :dim] += own.sum(axis=0, dtype=np.int64)
                total[c, dim] += len(own)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])], ["cluster", "part", "total"])

    found = state.select("x", "cluster").mapInArrow(sums, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    total = np.zeros((k, dim + 1), np.int64)
    for r in found.collect():  # k * (dim + 1) rows at most
        total[r.cluster, r.part] = r.total
    out = now.copy()
    filled = total[:, dim] > 0
    out[filled] = total[filled, :dim] // total[filled, dim:]
    return out


def clustered(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, x, norm, dots, cluster, distance) of every vector that takes part, the final centroids)."""
    spark = embeddings.sparkSession
    vectors = staged(whole_numbers(embeddings, dim, scale), "vectors")
    now = first_centroids(vectors, k, seed).reshape(-1, dim)
    if not len(now):
        return assigned(vectors, None, np.zeros((1, dim), np.int64)), now
    before, state = None, vectors
    for step in range(rounds + 1):
        path = session.STAGED[-1]
        state = staged(assigned(state, before, now), "round")
        remove(spark, path)
        if step < rounds:
            before, now = now, moved_centroids(state, now)
    return state, now


def centroid_clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    state, now = clustered(embeddings, k, rounds, dim, scale, seed)
    by_cluster = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    total = sum(int(r.inertia) for r in by_cluster)
    names = {c: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for c, row in enumerate(now)}
    rows = [(r.cluster, int(r.inertia), total, names[r.cluster]) for r in by_cluster]
    about = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

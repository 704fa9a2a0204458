"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is joins and aggregations on edges, so no node's neighbours are ever gathered in one
place: minima combine before the shuffle, and the join of a hub's edges with its one minimum is a
plain equi-join that adaptive execution can split. Between steps each task contracts what it holds
to a spanning forest, and the edges are written below ``spark.checkpoint.dir``. A graph of at most
``FOREST_EDGES`` edges, given or contracted so far, is finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

FOREST_EDGES = 400_000


def forest(pairs: list[tuple]) -> list[tuple]:
    """(node, smallest node it is joined with) for all nodes of the pairs but those smallest ones."""
    parent: dict = {}

    def find(x):
        root = x
        while (above := parent.get(root, root)) != root:
            root = above
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent)]


def _contracted(edges: DataFrame) -> DataFrame:
    schema = edges.schema
    types = [f.dataType for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            found = forest(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], ["u", "v"]
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) > FOREST_EDGES:
                yield out()
                held = []
        if held:
            yield out()

    assert types[0] == types[1]
    return edges.mapInArrow(run, schema)


def _star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star; ``edges`` has u > v."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionByName(turned).groupBy("u").agg(F.min("v").alias("low"))
    least = least.select(F.col("u").alias("v"), F.least("u", "low").alias("low"))
    large = edges.join(least, "v").select("u", F.col("low").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(lowest, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge, roots included.

    Directions, repeated edges and loops do not matter; an edge with a null end is no edge.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = staged(pairs.distinct(), "edges")
    small = now.count() <= FOREST_EDGES
    if not small:
        now = staged(_contracted(now), "edges")
    while not small:
        parents = now.groupBy("u").agg(F.count("v").alias("n"))
        above = parents.select(F.col("u").alias("v"))
        unsettled = parents.where("n > 1").select("u").unionByName(now.join(above, "v", "left_semi").select("u"))
        if unsettled.isEmpty():
            break
        now = staged(_contracted(_star_step(now)), "edges")
        small = now.count() <= FOREST_EDGES
    if small:
        now = staged(_contracted(now.coalesce(1)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

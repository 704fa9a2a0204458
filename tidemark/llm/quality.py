"""Quality classifier: a convolutional network over the bytes of the whole text, in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it. Learned filters of
``WIDTH`` bytes run over each chunk and each filter keeps its largest response (max pooling). The
chunk values are combined over the document by their mean and their maximum, and one logistic unit
turns both into a probability.

The network is fitted on the driver from a bounded sample (``per_class`` labelled documents of each
label, none longer than ``max_train_bytes``; both are parameters). Scoring is one pass over the
documents without a shuffle, and every byte of every text takes part.

A null text is scored like an empty one. Repeated rows are scored one by one. Labels that contradict
each other for one document are left out of the sample. Without any label of one of the two classes
the network stays at the share of label 1 (0.5 if there is no label at all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import flat, pieces

CHUNK, OVERLAP, WIDTH, FILTERS = 512, 32, 6, 16
PAD = 255  # a byte that UTF-8 never holds
PER_CLASS, MAX_TRAIN_BYTES, EPOCHS, SEED = 1200, 1 << 16, 8, 5


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk matrix, row of each chunk). Every row has a chunk; ``WIDTH - 1`` bytes of padding follow its end."""
    step = CHUNK - OVERLAP
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-(lengths - OVERLAP) // step))
    row = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + nth * step
    at = start[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = at < offsets[row + 1][:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.uint8), row
    return np.where(inside, data[np.minimum(at, len(data) - 1)], PAD).astype(np.uint8), row


def combined(pooled: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document vectors (mean and maximum of the chunk values), chunks per document, start of each document."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[start, len(row)])
    mean = np.add.reduceat(pooled, start, axis=0) / count[:, None]
    return np.hstack([mean, np.maximum.reduceat(pooled, start, axis=0)]), count, start


class Network:
    """Filter tables (one row per filter position and byte value), filter offsets and the output unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.offset = np.zeros(FILTERS, np.float32)
        self.out = np.r_[rng.normal(0, 0.3, FILTERS), np.zeros(FILTERS)].astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.mute = False  # no two classes to learn from: the bias alone decides

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.offset, self.out, self.bias]

    def pooled(self, chunks: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter in each chunk; ``pairs`` are the tables of two positions at once."""
        found = np.empty((len(chunks), FILTERS), np.float32)
        for low in range(0, len(chunks), 64):
            part = chunks[low : low + 64]
            two = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            total = pairs[0][two[:, :CHUNK]]
            for k in range(1, WIDTH // 2):
                total += pairs[k][two[:, 2 * k : 2 * k + CHUNK]]
            found[low : low + 64] = total.max(axis=1)
        return np.maximum(found + self.offset, 0)

    def pair_tables(self) -> list[np.ndarray]:
        t = self.tables
        return [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def scores(self, data: np.ndarray, offsets: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        if self.mute:
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-float(self.bias[0]))))
        chunks, row = chunked(data, offsets)
        vectors, _, _ = combined(self.pooled(chunks, pairs), row)
        z = vectors.astype(np.float64) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, chunks: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss over some whole documents."""
        total = self.tables[0][chunks[:, :CHUNK]]
        for k in range(1, WIDTH):
            total += self.tables[k][chunks[:, k : k + CHUNK]]
        where = total.argmax(axis=1)
        best = np.take_along_axis(total, where[:, None, :], axis=1)[:, 0] + self.offset
        pooled = np.maximum(best, 0)
        vectors, count, start = combined(pooled, row)
        p = 1 / (1 + np.exp(-np.clip(vectors @ self.out + self.bias[0], -30, 30)))
        error = ((p - label) * weight / len(label)).astype(np.float32)
        doc = np.repeat(np.arange(len(count)), count)
        back = (error[:, None] * self.out[None, :FILTERS] / count[:, None])[doc]
        top = pooled == vectors[doc, FILTERS:]
        back = back + (error[:, None] * self.out[None, FILTERS:])[doc] * top
        back *= best > 0
        tables = np.zeros_like(self.tables)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            byte = np.take_along_axis(chunks, where + k, axis=1)
            flat_at = (byte.astype(np.int64) * FILTERS + filters).ravel()
            tables[k] = np.bincount(flat_at, back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        tables[:, PAD] = 0
        return [tables, back.sum(axis=0), error @ vectors, np.array([error.sum()])]


def fit(texts: list[bytes], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over small groups of whole documents. ``share``: of label 1 among all labelled documents, if not that of the sample."""
    net, y = Network(seed), np.array(labels, np.float32)
    share = float(np.clip((y.mean() if len(y) else 0.5) if share is None else share, 0.01, 0.99))
    if not len(y) or y.min() == y.max():
        net.bias[0], net.mute = np.log(share / (1 - share)), True
        return net
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    ready = [chunked(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p, np.float64) for p in net.parameters()]
    second = [np.zeros_like(p, np.float64) for p in net.parameters()]
    step, group = 0, 16
    epochs = max(epochs, -(-120 * group // len(y)))  # small samples still get some steps
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for low in range(0, len(order), group):
            picked = order[low : low + group]
            chunks = np.concatenate([ready[i] for i in picked])
            row = np.repeat(np.arange(len(picked)), [len(ready[i]) for i in picked])
            step += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(chunks, row, y[picked], weight[picked]), first, second):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def is_held_out(doc_id="doc_id"):
    """Whether a row belongs to the third that nothing is learned from; a null id has no remainder, so it does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label) of the documents that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & ~is_held_out() & F.col(label).isin(0, 1)).groupBy("doc_id")
    return known.agg(F.min(label).alias("label"), F.max(label).alias("high")).where("label = high").select("doc_id", "label")


def sample(documents: DataFrame, known: DataFrame, per_class: int = PER_CLASS, max_train_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, label): up to ``per_class`` documents of each class, chosen by the hash of their id.

    Of several rows with one doc_id the smallest text is taken, so the bound holds for rows too.
    """
    pick = lambda value: known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_train_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id")  # two classes of per_class rows at most
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def trained(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Network:
    known = learnable(labels, label)
    share = known.agg(F.avg("label")).first()[0]
    rows = sorted(sample(documents, known, per_class).collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text.encode() for r in rows], [r.label for r in rows], share)


def scored(documents: DataFrame, net: Network, keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """The columns ``keep`` (all, unless given) and the probability of label 1; one row for each input row."""
    keep = list(documents.columns) if keep is None else keep
    extra = [] if "text" in keep else ["text"]
    keep = [c for c in keep if c != column]
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pair_tables()
        for batch in batches:
            for part in pieces(batch):
                score = net.scores(*flat(part.column("text")), pairs)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(score)], [*keep, column])

    return documents.select(*keep, *extra).mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    net = trained(documents, labels, label, per_class)
    rows = scored(documents, net, ["doc_id"])
    return rows.select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(documents: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The documents, with all their columns, that the classifier gives at least ``threshold``."""
    name = "score"
    while name in documents.columns:
        name += "_"
    return scored(documents, trained(documents, labels, label, per_class), column=name).where(F.col(name) >= threshold).drop(name)

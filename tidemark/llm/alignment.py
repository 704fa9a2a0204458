"""Alignment of the tokens of two vocabularies by sparse incidence matrices.

Both tokenizers encode the same bytes (a blank and the text). A token-byte incidence matrix has a row for
each token and a one for each byte it covers, a group incidence matrix a row for each token id of a document
and a count for each group it occurs in. Groups are the stretches between byte offsets at which both
tokenizations end. With both in CSR form,

* A·Bᵀ of the token-byte matrices has an entry for each pair of tokens that overlap, its value the shared bytes,
* A·Bᵀ of the group matrices has an entry for each pair of ids linked in a document, its value the linked
  pairs of occurrences.

``product`` is Gustavson's: each row of the result is the sum of the rows of the second matrix that the entries
of the first one's row name; rows are taken in blocks of bounded size, so a long stretch without a common end
costs time and no memory.

Documents are encoded once; their linked id pairs are written with them. Corpus-wide counts are sums combined
in each task first. The most frequent pairs, at most ``HEAD`` and chosen by their counts, are broadcast and
looked up in place; the remaining, rare, ones are joined by (a, b). So the common pairs never meet in one task.

Texts are cut for the encoders at blanks between two characters that are no white space, where neither
vocabulary carries a token over, so a very long text is encoded in parts of ``PART`` characters.

Null and empty texts, and texts that a vocabulary does not give back byte by byte, have no tokens and no links.
Repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

from .flat import flat, pieces, table
from .tokens import stable

PART = 1 << 16
PIECE = 1 << 19  # bytes of text that are aligned at once
ENTRIES = 1 << 22  # of a product that are held before they are added up
HEAD = 1 << 21  # pairs of ids that are broadcast
HELD = 1 << 21  # counted pairs that a task holds before it hands them on
_LATIN = table((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0x80, 0xBF), (0xC3, 0xC5))


# --- sparse matrices ---------------------------------------------------------------------------


@dataclass
class Csr:
    """Row i has the entries ``start[i]:start[i + 1]`` of ``column`` and ``value``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, rows: int, width: int) -> Csr:
        """The incidence matrix of (row, column) pairs; a pair that comes several times counts so often."""
        key = row * np.int64(width) + column
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        key, value = added_up(key, np.ones(len(key), np.int64))
        row = key // width
        return Csr(np.searchsorted(row, np.arange(rows + 1)), key - row * width, value, width)


def added_up(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their values) of sorted keys."""
    if not len(key):
        return key, value
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value, first)


def within(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of the counts n, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def product(a: Csr, b: Csr, entries: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of a·b, in order, by blocks of whole rows."""
    sizes = b.start[a.column + 1] - b.start[a.column]
    before = np.r_[0, np.cumsum(sizes)][a.start]  # terms before each row
    low, rows = 0, len(a.start) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(before, before[low] + entries, side="right")) - 1)
        own = slice(a.start[low], a.start[high])
        n = sizes[own]
        row = np.repeat(np.repeat(np.arange(low, high), np.diff(a.start[low : high + 1])), n)
        at = np.repeat(b.start[a.column[own]], n) + within(n)
        key = row * np.int64(b.width) + b.column[at]
        value = np.repeat(a.value[own], n) * b.value[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        key, value = added_up(key, value)
        row = key // b.width
        yield row, key - row * b.width, value
        low = high


# --- tokens as bytes ---------------------------------------------------------------------------


class Vocabulary:
    """Token bytes by id, flat."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids], n) + within(n)]


def _byte_level() -> dict[str, int]:
    """The printable character that stands for each byte: its own where that is printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Encoder of a byte-level vocabulary; special strings in a text are plain text."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.full.no_truncation()
        self.full.no_padding()
        characters = _byte_level()
        entries = [b""] * self.full.get_vocab_size()
        for entry, k in self.full.get_vocab().items():
            entries[k] = bytes(characters[c] for c in entry) if all(c in characters for c in entry) else entry.encode()
        self.vocabulary = Vocabulary(entries)
        self.plain = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def latin(texts: list[str]) -> np.ndarray:
        """Texts of ASCII and Latin letters, in which both libraries split alike."""
        data, offsets = flat(pa.array(texts, pa.string()))
        good = _LATIN[data]
        good[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        bad = np.r_[0, np.cumsum(~good)]
        return bad[offsets[1:]] == bad[offsets[:-1]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = self.latin(texts) & (self.plain is not None)
        out = [self.plain.encode_ordinary(t) if p else None for t, p in zip(texts, plain.tolist())]
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            for i, found in zip(rest, self.full.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = found.ids
        return out


class PieceBpe:
    """Encoder of a piece vocabulary, which adds the blank in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            entries.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())
        self.vocabulary = Vocabulary(entries)
        #: whether no piece has a blank behind another character, so that texts may be cut in front of one
        self.cuts = not any("▁" in self.model.id_to_piece(k).lstrip("▁") for k in range(len(entries)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def parts(text: str, size: int) -> list[str]:
    """The text cut in front of blanks, in parts of at least ``size`` characters."""
    out, low = [], 0
    while (cut := next(stable(text, low + size, len(text)), None)) is not None:
        out.append(text[low:cut])
        low = cut
    return [*out, text[low:]]


# --- documents ---------------------------------------------------------------------------------


class Aligned:
    """The tokens of some documents by both vocabularies, their groups and links.

    Arrays are flat: ``ids[v]``, ``end[v]`` (byte offset), ``group[v]`` and ``row[v]`` of the tokens of vocabulary v;
    ``bound`` are the ends of groups, ``first`` the byte offset of each row. Rows without tokens have no bytes.
    """

    def __init__(self, texts: list[str | None], a: ByteBpe, b: PieceBpe, size: int = PART):
        cut = [parts(f" {t}", size) if b.cuts else [f" {t}"] for t in texts if t]
        given = np.array([bool(t) for t in texts], bool)
        number = np.repeat(np.flatnonzero(given), [len(p) for p in cut])
        flat_parts = [p for own in cut for p in own]
        raw = [f" {t}".encode() if t else b"" for t in texts]
        self.vocabularies = (a.vocabulary, b.vocabulary)
        self.ids, self.row = [], []
        for encoder in (a, b):
            found = encoder.encode(flat_parts)
            counts = np.array([len(f) for f in found], np.int64)
            self.ids.append(np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())))
            self.row.append(np.repeat(number, counts).astype(np.int64))
        kept = self._given_back(raw)
        for v in (0, 1):
            own = kept[self.row[v]]
            self.ids[v], self.row[v] = self.ids[v][own], self.row[v][own]
        self.first = np.r_[0, np.cumsum(np.where(kept, [len(r) for r in raw], 0))].astype(np.int64)
        self.size = [self.vocabularies[v].size[self.ids[v]] for v in (0, 1)]
        self.end = [np.cumsum(s) for s in self.size]
        common = np.zeros(int(self.first[-1]) + 1, bool)
        common[self.end[0]] = True
        also = np.zeros(len(common), bool)
        also[self.end[1]] = True
        common &= also
        self.bound = np.flatnonzero(common)
        before = np.cumsum(common)  # group ends up to each offset
        self.group = [before[e - 1] for e in self.end]
        self.rows = len(texts)

    def _given_back(self, raw: list[bytes]) -> np.ndarray:
        """Rows that both vocabularies give back byte by byte."""
        lengths = np.array([len(r) for r in raw], np.int64)
        kept = lengths > 0
        totals = [np.bincount(self.row[v], self.vocabularies[v].size[self.ids[v]], len(raw)).astype(np.int64) for v in (0, 1)]
        kept &= (totals[0] == lengths) & (totals[1] == lengths)
        source = np.frombuffer(b"".join(r for r, k in zip(raw, kept.tolist()) if k), np.uint8)
        owner = np.repeat(np.flatnonzero(kept), lengths[kept])
        for v in (0, 1):
            joined = self.vocabularies[v].bytes_of(self.ids[v][kept[self.row[v]]])
            kept[owner[joined != source]] = False
            source, owner = source[kept[owner]], owner[kept[owner]]
        return kept

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, shared bytes): the product of the token-byte incidence matrices."""
        n = int(self.first[-1])
        a = Csr(np.r_[0, self.end[0]], np.arange(n), np.ones(n, np.int64), n)
        tokens = len(self.ids[1])
        transposed = Csr(np.arange(n + 1), np.repeat(np.arange(tokens), self.size[1]), np.ones(n, np.int64), max(1, tokens))
        return product(a, transposed)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, A id, B id, links): the product of the group incidence matrices, a row of A for each id of a document."""
        width = len(self.vocabularies[0].size)
        names, number = np.unique(self.row[0] * width + self.ids[0], return_inverse=True)
        groups = max(1, len(self.bound))
        a = Csr.of(number, self.group[0], len(names), groups)
        b = Csr.of(self.group[1], self.ids[1], groups, len(self.vocabularies[1].size))
        found = list(product(a, b))
        name, id_b, n = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        return names[name] // width, names[name] % width, id_b, n

    def counts(self, v: int) -> np.ndarray:
        return np.bincount(self.row[v], minlength=self.rows)

    def group_rows(self) -> np.ndarray:
        """The row of each group."""
        return np.searchsorted(self.first, self.bound - 1, side="right") - 1

    @staticmethod
    @cache
    def _words(size: int) -> np.ndarray:
        """Each id in decimal with what follows it: a comma, a bar, a semicolon."""
        return np.array([[f"{k}{end}" for k in range(size)] for end in ",|;"], object)

    def spelled(self) -> list[str]:
        """The groups of each row as ``a1,a2|b1;a3|b2,b3``."""
        last = [np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool) for g in self.group]
        row = np.concatenate(self.row)
        side = np.repeat([0, 1], [len(i) for i in self.ids])
        order = np.argsort(np.concatenate(self.group) * 2 + side, kind="stable")
        words = self._words(max(len(v.size) for v in self.vocabularies))
        mark = np.concatenate([np.where(last[0], 1, 0), np.where(last[1], 2, 0)])
        text = words[mark[order], np.concatenate(self.ids)[order]].tolist()
        bounds = np.searchsorted(row[order], np.arange(self.rows + 1)).tolist()
        return ["".join(text[low:high])[:-1] for low, high in zip(bounds[:-1], bounds[1:])]


#: Makes the two encoders in a task.
Encoders = Callable[[], tuple[ByteBpe, PieceBpe]]
DOCUMENT = "n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string"


def aligned(documents: DataFrame, encoders: Encoders) -> DataFrame:
    """(doc_id, place, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, a, b, n), written once.

    ``a``, ``b``, ``n``: the linked id pairs of the document, each once, and their links; ``place`` tells rows apart.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in DOCUMENT.split(", ")), "a", "b", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders()
        for batch in batches:
            for part in pieces(batch, size=PIECE):
                found = Aligned(part.column("text").to_pylist(), *both)
                row, a, b, n = found.links()
                rows = found.rows
                overlaps = np.zeros(rows, np.int64)
                for token, _, _ in found.overlaps():
                    overlaps += np.bincount(found.row[0][token], minlength=rows)
                at = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array(x.astype(np.int64)) for x in (found.counts(0), found.counts(1), np.bincount(found.group_rows(), minlength=rows), overlaps)),
                        pa.array(np.bincount(row, n, rows).astype(np.int64)),
                        pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.spelled()], pa.string()),
                        *(pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (a, b, n)),
                    ],
                    names,
                )

    found = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {DOCUMENT}, a array<int>, b array<int>, n array<int>")
    return staged(found.withColumn("place", F.monotonically_increasing_id()), "aligned")


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, links) of the id pairs of a batch; a key holds both ids."""
    a, b, n = (batch.column(c) for c in ("a", "b", "n"))
    row = np.repeat(np.arange(batch.num_rows), a.value_lengths().to_numpy())
    return row, (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)


def _halves(key: np.ndarray) -> list[pa.Array]:
    return [pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32))]


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, documents, best): in how many documents each pair of ids is linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = _pairs(batch)[1]
            key, count = np.concatenate([key, more]), np.concatenate([count, np.ones(len(more), np.int64)])
            order = np.argsort(key, kind="stable")
            key, count = added_up(key[order], count[order])
            if len(key) > HELD:
                yield pa.RecordBatch.from_arrays([*_halves(key), pa.array(count)], ["a", "b", "documents"])
                key, count = key[:0], count[:0]
        yield pa.RecordBatch.from_arrays([*_halves(key), pa.array(count)], ["a", "b", "documents"])

    counts = links.select("a", "b", "n").mapInArrow(run, "a int, b int, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    counts = staged(counts, "counts")
    highest = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return staged(counts.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "pairs")


def _head(pairs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, documents, best) of the pairs from some count on, the lowest that leaves no more than ``head``."""
    level = F.floor(F.log2("documents") * 8)
    left, least = head, None
    for r in pairs.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        if r["count"] > left:
            break
        left, least = left - r["count"], r.level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    found = pairs.where(level >= least).toArrow()
    key = (found["a"].to_numpy().astype(np.int64) << 32) | found["b"].to_numpy()
    order = np.argsort(key)
    return key[order], found["documents"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]


def pair_sums(links: DataFrame, pairs: DataFrame, head: int = HEAD) -> DataFrame:
    """(place, n_best, count_sum) of every row of ``aligned``."""
    common = links.sparkSession.sparkContext.broadcast(_head(pairs, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = common.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            row, key, n = _pairs(batch)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            r, at, n_known = row[known], at[known], n[known]
            sums = np.zeros(len(place), np.int64)
            np.add.at(sums, r, n_known * documents[at])
            bests = np.zeros(len(place), np.int64)
            np.add.at(bests, r, n_known * best[at])
            rest = ~known
            none = len(place)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([place, place[row[rest]]])),
                    *(pa.array([None] * none + h.to_pylist(), pa.int32()) for h in _halves(key[rest])),
                    pa.array(np.concatenate([bests, n[rest]])),
                    pa.array(np.concatenate([sums, n[rest]])),
                ],
                ["place", "a", "b", "n_best", "count_sum"],
            )

    found = staged(links.select("place", "a", "b", "n").mapInArrow(run, "place long, a int, b int, n_best long, count_sum long"), "sums")
    rare = found.where("a IS NOT NULL").join(pairs, ["a", "b"])
    rare = rare.select("place", F.when(F.col("best"), F.col("n_best")).otherwise(0).alias("n_best"), (F.col("count_sum") * F.col("documents")).alias("count_sum"))
    every = found.where("a IS NULL").select("place", "n_best", "count_sum").unionByName(rare)
    return every.groupBy("place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(documents: DataFrame, encoders: Encoders, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps) of every row."""
    links = aligned(documents, encoders)
    sums = pair_sums(links, pair_counts(links), head)
    return links.drop("a", "b", "n").join(sums, "place").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"
    )


def token_links(documents: DataFrame, encoders: Encoders) -> DataFrame:
    """(doc_id, a, b, overlaps) of every row: the ids of both tokenizations and (A token, B token, shared bytes) of those that overlap."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders()
        for batch in batches:
            for part in pieces(batch, size=PIECE):
                found = Aligned(part.column("text").to_pylist(), *both)
                first = [np.searchsorted(found.row[v], np.arange(found.rows + 1)) for v in (0, 1)]
                lists = [pa.ListArray.from_arrays(pa.array(first[v].astype(np.int32)), pa.array(found.ids[v].astype(np.int32))) for v in (0, 1)]
                triples: list[list[list[int]]] = [[] for _ in range(found.rows)]
                for token, other, shared in found.overlaps():
                    row = found.row[0][token]
                    for r, x in zip(row.tolist(), np.stack([token - first[0][row], other - first[1][row], shared], axis=1).tolist()):
                        triples[r].append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *lists, pa.array(triples, pa.list_(pa.list_(pa.int64())))], ["doc_id", "a", "b", "overlaps"]
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, overlaps array<array<long>>")

"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is one Arrow batch of whole documents. Its words become symbols: the words of the benchmark
have numbers, every other word is a separator (no phrase can cross it), and only stretches long
enough for some phrase are indexed. The index is the Burrows-Wheeler transform of these symbols in a
wavelet matrix, with suffix positions sampled at every ``SAMPLE``-th symbol of a stretch. All phrases
are searched backward at once, their rows are walked to sampled positions, and the word spans found
are merged for each document. Nothing is shuffled and no document is split between shards.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter
item. Words are compared by 64-bit hash. The phrases of about ``PHRASES`` words travel to the tasks; a
larger benchmark is searched in as many passes as needed, one block of it at a time on the driver.

Null and empty texts have no words and are never hit. Repeated rows are judged one by one. Items
with a null id or without words count for nothing; rows that repeat an item_id are one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

from .flat import PUNCTUATION, Words, flat, lowered, pieces, words

WINDOW = 10
SAMPLE = 8
PHRASES = 200_000


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.r_[now[bit == 0], now[bit == 1]]
        place = np.zeros(1 << bits, np.int64)
        values, first = np.unique(now, return_index=True)
        place[values] = first  # where the symbol's block begins after all levels
        self.begin = place

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        at = stop
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            high = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(high == 1, zeros + ones[at], at - ones[at])
        return at - self.begin[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Zeros are separators, each smaller than all words and unlike any other."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    gaps = np.flatnonzero(symbols == 0)
    rank[gaps] = np.arange(len(gaps))
    step = 0
    while True:
        follow = np.zeros(n, np.int64)
        if step:
            follow[: n - step] = rank[step:] + 1
        order = np.lexsort((follow, rank)) if step else np.argsort(rank, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (follow[order[1:]] != follow[order[:-1]])
        if fresh.all():
            return order
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh) - 1
        rank, step = new, max(1, 2 * step)


class FMIndex:
    """Search of symbol phrases in stretches of symbols between zeros."""

    def __init__(self, symbols: np.ndarray, bits: int):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the first symbol is a zero, so wrapping round is harmless
        self.tree = WaveletMatrix(before, bits)
        self.before = before
        counts = np.bincount(symbols, minlength=1 << bits)
        self.first = np.cumsum(counts) - counts
        self.counts = counts
        gap = np.maximum.accumulate(np.where(symbols == 0, np.arange(len(symbols)), 0))
        nth = np.arange(len(symbols)) - gap - 1
        self.position = np.where(nth[order] % SAMPLE == 0, order, -1)  # of the sampled rows; stretches start with one

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases; row i of ``phrases`` ends at its right edge, ``length[i]`` long."""
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last] + self.counts[last]
        for k in range(1, phrases.shape[1]):
            go = np.flatnonzero((length > k) & (low < high))
            if not len(go):
                break
            symbol = phrases[go, -1 - k]
            low[go] = self.first[symbol] + self.tree.rank(symbol, low[go])
            high[go] = self.first[symbol] + self.tree.rank(symbol, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in some rows, by walking back to sampled ones."""
        out, walked = np.full(len(rows), -1), 0
        todo, now = np.arange(len(rows)), rows
        while len(todo):
            known = self.position[now] >= 0
            out[todo[known]] = self.position[now[known]] + walked
            todo, now = todo[~known], now[~known]
            symbol = self.before[now]
            now = self.first[symbol] + self.tree.rank(symbol, now)
            walked += 1
        return out


class Phrases:
    """The distinct phrases of some items as word hashes, right-aligned, and the items of each."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        owners: dict[tuple, set[str]] = {}
        for item, hashes in items:
            for k in range(max(1, len(hashes) - window + 1)):
                owners.setdefault(tuple(hashes[k : k + window]), set()).add(item)
        owners.pop((), None)
        self.owners = list(owners.values())
        self.length = np.array([len(p) for p in owners], np.int64)
        self.vocabulary = np.unique(np.array([h for p in owners for h in p], np.uint64))
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.symbols = np.zeros((len(owners), window), np.int64)
        for row, p in zip(self.symbols, owners):
            row[window - len(p) :] = self.of(np.array(p, np.uint64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 1 on; 0 for words that no phrase has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def find(self, symbols: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence; ``edges`` are the first words of documents."""
        none = np.zeros(0, np.int64)
        if not len(self.length) or not len(symbols):
            return none, none
        breaks = symbols == 0
        starts = np.zeros(len(symbols) + 1, bool)
        starts[edges] = True
        starts[0] = starts[-1] = True
        starts[:-1] |= breaks
        starts[1:] |= breaks
        bounds = np.flatnonzero(starts)
        size = np.diff(bounds)
        good = (symbols[bounds[:-1]] > 0) & (size >= self.length.min())
        bounds, size = bounds[:-1][good], size[good]
        if not len(size):
            return none, none
        # a zero, then each stretch with a zero behind it
        total = np.r_[0, np.cumsum(size + 1)]
        packed = np.zeros(total[-1] + 1, np.int64)
        origin = np.full(len(packed), -1)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        to = np.repeat(total[:-1] + 1, size) + inside
        origin[to] = np.repeat(bounds, size) + inside
        packed[to] = symbols[origin[to]]
        index = FMIndex(packed, self.bits)
        low, high = index.search(self.symbols, self.length)
        phrase = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[phrase]
        return phrase, origin[index.locate(rows)]


class Shard:
    """Hits of the phrases in the texts of one batch."""

    def __init__(self, column: pa.Array, phrases: Phrases):
        self.n_words: list[np.ndarray] = []
        symbols = []
        for part in pieces(pa.RecordBatch.from_arrays([column], ["text"])):
            w = self.words(part.column(0))
            symbols.append(phrases.of(w.hash))
            self.n_words.append(np.diff(w.first))
        self.n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        self.first = np.r_[0, np.cumsum(self.n_words)]
        phrase, start = phrases.find(np.concatenate(symbols) if symbols else np.zeros(0, np.int32), self.first)
        change = np.zeros(int(self.first[-1]) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + phrases.length[phrase], -1)
        self.hit = np.cumsum(change[:-1]) > 0
        self.n_hit = np.diff(np.r_[0, np.cumsum(self.hit)][self.first])
        self.items: dict[int, set[str]] = {}
        for row, p in set(zip((np.searchsorted(self.first, start, side="right") - 1).tolist(), phrase.tolist())):
            self.items.setdefault(row, set()).update(phrases.owners[p])

    @staticmethod
    def words(column: pa.Array) -> Words:
        data, offsets = flat(column)
        return words(lowered(data), offsets, PUNCTUATION)

    def spans(self, row: int) -> list[list[int]]:
        """Merged [first, last) word spans of one document."""
        own = np.r_[False, self.hit[self.first[row] : self.first[row + 1]], False]
        edge = np.flatnonzero(own[1:] != own[:-1])
        return edge.reshape(-1, 2).tolist()


class PhraseBlocks:
    """The phrases of the benchmark in blocks of about ``limit`` words, each small enough to travel to every task.

    Items are stored as stretches of words that share ``WINDOW - 1`` words with the next one, so a long item
    is spread over the blocks. A block is collected when it is asked for and not kept here.
    """

    def __init__(self, benchmark: DataFrame, limit: int = PHRASES):
        step = max(1, min(limit // 8, 4096))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    w = Shard.words(part.column("text"))
                    rows, lists = [], []
                    for row, (low, high) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                        for k in range(low, max(low, high - WINDOW) + 1, step):
                            rows.append(row)
                            lists.append(w.hash[k : min(k + step + WINDOW - 1, high)].view(np.int64))
                    item = part.column("item").take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([item, pa.array(lists, pa.list_(pa.int64()))], ["item", "words"])

        items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
        self.items = items.mapInArrow(hashed, "item string, words array<long>").where(F.size("words") > 0)
        total = self.items.agg(F.sum(F.least(F.size("words"), F.lit(step)))).first()[0] or 0
        self.blocks = -(-total // limit)
        if self.blocks > 1:
            block = F.pmod(F.xxhash64("item", "words"), F.lit(self.blocks))
            self.items = staged(self.items.withColumn("block", block), "phrases")

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, k: int) -> Phrases:
        if not 0 <= k < self.blocks:
            raise IndexError(k)
        rows = (self.items.where(F.col("block") == k) if self.blocks > 1 else self.items).collect()
        return Phrases([(r.item, np.array(r.words, np.int64).view(np.uint64).tolist()) for r in rows])


def hits(documents: DataFrame, benchmark: DataFrame, limit: int = PHRASES) -> DataFrame:
    """(doc_id, n_words, hit, items) of every row: merged [first, last) spans of hit words, and the ids of the items found.

    More than one pass over the texts (a benchmark of more than ``limit`` words) is put together by doc_id and text.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text")

    def searched(source: DataFrame, phrases: Phrases, ids: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = Shard(batch.column("text"), phrases)
                spans = [s.spans(i) if n else [] for i, n in enumerate(s.n_hit)]
                items = [sorted(s.items.get(i, ())) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ids),
                        pa.array(s.n_words),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    [*ids, "n_words", "hit", "items"],
                )

        extra = ", tag long" if "tag" in ids else ""
        return source.mapInArrow(run, f"doc_id {kind}{extra}, n_words long, hit array<array<long>>, items array<string>")

    blocks = PhraseBlocks(benchmark, limit)
    if len(blocks) < 2:
        return searched(rows, blocks[0] if len(blocks) else Phrases([]), ["doc_id"])
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    # a pass is written before the next block is collected: the driver holds one
    passes = [staged(searched(tagged, blocks[k], ["doc_id", "tag"]), "pass").withColumn("pass", F.lit(k)) for k in range(len(blocks))]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    put = every.groupBy("doc_id", "tag").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.count_if(F.col("pass") == 0).cast("int").alias("rows"),
    )
    start = F.array().cast("array<array<long>>")
    overlaps = lambda held, s: (F.size(held) > 0) & (s[0] <= F.element_at(held, -1)[1])
    merged = F.aggregate(
        "hit",
        start,
        lambda held, s: F.when(
            overlaps(held, s),
            F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.array(F.element_at(held, -1)[0], F.greatest(F.element_at(held, -1)[1], s[1])))),
        ).otherwise(F.concat(held, F.array(s))),
    )
    return put.select("doc_id", "n_words", merged.alias("hit"), "items", F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("copy")).drop("copy")


def contamination(documents: DataFrame, benchmark: DataFrame, limit: int = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return hits(documents, benchmark, limit).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def _cut(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes of some [first, last) word spans."""
    w, raw = Shard.words(pa.array([text], pa.string())), text.encode()
    kept, at = [], 0
    for low, high in spans:
        kept.append(raw[at : w.start[low]])
        at = int(w.stop[high - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _cleaned(texts: pa.Array, phrases: Phrases) -> list[str | None]:
    """The texts without the bytes of their hit spans, searched again until nothing is hit (a cut can join words to a new phrase)."""
    out = texts.to_pylist()
    todo = list(range(len(out)))
    while todo:
        s = Shard(pa.array([out[i] for i in todo], pa.string()), phrases)
        again = [(k, i) for k, i in enumerate(todo) if s.n_hit[k]]
        for k, i in again:
            out[i] = _cut(out[i], s.spans(k))
        todo = [i for _, i in again]
    return out


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_cut(t, x) for t, x in zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(texts, pa.string())], ["name", "text"])


def _cleaned_texts(texts: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    """(name, text) of the texts that change, for a benchmark of several blocks; ``texts`` has the same columns.

    As ``_cleaned``: the spans of all blocks are found in one text and cut together, and what was cut is searched again.
    """
    now, rounds = texts, []
    while True:
        # equal texts have equal spans
        found = hits(now.withColumnRenamed("name", "doc_id"), benchmark, limit).where(F.size("hit") > 0)
        found = found.groupBy(F.col("doc_id").alias("name")).agg(F.first("hit").alias("hit"))
        cut = now.dropDuplicates(["name"]).join(found, "name").select("name", "text", "hit").mapInArrow(_cut_texts, "name string, text string")
        now = staged(cut, "cut")
        if now.isEmpty():
            break
        rounds.append(now.withColumn("round", F.lit(len(rounds))))
    every = rounds[0] if rounds else now.withColumn("round", F.lit(0))
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every.groupBy("name").agg(F.max_by("text", "round").alias("text"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, limit: int = PHRASES) -> DataFrame:
    """The documents, with all their columns, their text without benchmark phrases (``n_chars`` follows, if present)."""
    columns = documents.columns

    def cleaned(phrases: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = pa.array(_cleaned(batch.column("text"), phrases), pa.string())
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in columns], columns)

        return run

    blocks = PhraseBlocks(benchmark, limit)
    if len(blocks) == 1:
        out = documents.mapInArrow(cleaned(blocks[0]), documents.schema)
    elif len(blocks) == 0:
        out = documents
    else:
        name = F.md5(F.col("text").cast("binary"))
        texts = _cleaned_texts(documents.where("text IS NOT NULL").select(name.alias("name"), "text"), benchmark, limit)
        rows = documents.select(F.struct("*").alias("row"), name.alias("name"))
        out = rows.join(texts, "name", "left").select(*[F.coalesce("text", f"row.{c}").alias(c) if c == "text" else f"row.`{c}`" for c in columns])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out

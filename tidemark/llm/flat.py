"""Texts of an Arrow batch as one flat byte array, and the hashes that the operators share.

A column of strings is already one buffer of UTF-8 bytes with offsets, so words, shingles and
windows of many documents are found by a few numpy calls over the buffer instead of a loop over
rows. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C13  # odd, and 3 mod 8, so neither it nor its square is close to 1 in the low bits
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES.setflags(write=False)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the text of row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    filled = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = filled.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, count=len(wide) + 1 + wide.offset)[wide.offset :]
    data = wide.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 18)
        for at, base in enumerate((_ODD, _INVERSE)):
            grown = np.full(size, np.uint64(base))
            grown[0] = 1
            _powers[at] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any ranges of a byte array in constant time, from sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, down = _up_to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])
        self.down = down

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


@dataclass
class Words:
    """Words of all rows in order: byte range, row, hash; ``first[i]`` is the first word of row i."""

    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in the ranges (both ends belong to them)."""
    held = np.zeros(256, bool)
    for low, high in ranges:
        held[low : high + 1] = True
    return held


#: Separators of the two word rules of this subpackage, as byte values.
WHITE = table((0x20, 0x20), (0x09, 0x0D))
PUNCTUATION = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators; a run ends at the end of its row."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, stop, row, Prefix(data).ranges(start, stop), first)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches in which they are adjacent. Only for groups of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(cut).tolist()
        head = tuple(c[0] for c in columns)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *starts, batch.num_rows]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)

"""Exact token counts; huge texts are encoded in overlapping chunks that resynchronise.

A text of more than ``CHUNK`` characters is encoded in chunks that overlap by ``OVERLAP`` characters,
with the offset of every token. Two neighbouring chunks are spliced at an offset where

* both encodings have a token boundary,
* a blank stands between two characters that are no white space. The splitting pattern of the
  vocabulary never carries a piece over such a place and never looks back, so both encodings must
  agree from there on, and
* the tokens after it agree up to the end of the shorter chunk, less its last piece, which may have
  been cut.

If the overlap has no such offset it is doubled, up to the whole text. Only offsets are kept.

Texts of ASCII and Latin letters are encoded with the merge ranks of the vocabulary; in these both
libraries split alike. Any other text, and any with the marks of a special token, goes through the
tokenizer file itself, special strings handled as the file says.

Null texts count as empty (0 tokens). Repeated rows are counted one by one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import flat, pieces, table

CHUNK = 1 << 15
OVERLAP = 1 << 9
_PLAIN = table((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0x80, 0xBF), (0xC3, 0xC5))

#: text -> (ids, offset of the first character of each token; a token inside a character has the character's)
Encoder = Callable[[str], tuple[np.ndarray, np.ndarray]]


def stable(text: str, low: int, high: int) -> Iterator[int]:
    """Offsets in [low, high) at which every encoding has a boundary, wherever it began or ends beyond them."""
    at = text.find(" ", max(low, 1), high)
    while at >= 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            yield at
        at = text.find(" ", at + 1, high)


def splice(text: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], low: int, high: int) -> int | None:
    """An offset of the overlap [low, high) at which the two encodings (ids, offsets in the text) can be joined."""
    last = None
    for at in stable(text, low, high):
        last = at  # the last stable offset bounds what the cut at ``high`` can have changed
    if last is None:
        return None
    for at in stable(text, low, last):
        i, j = np.searchsorted(left[1], at), np.searchsorted(right[1], at)
        m, n = np.searchsorted(left[1], last), np.searchsorted(right[1], last)
        if (
            i < len(left[1]) and j < len(right[1]) and left[1][i] == at == right[1][j]
            and np.array_equal(left[0][i:m], right[0][j:n]) and np.array_equal(left[1][i:m], right[1][j:n])
        ):
            return at
    return None


def spliced_count(text: str, encode: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a text that is encoded chunk by chunk."""
    total, begin, stop = 0, 0, min(chunk, len(text))
    ids, at = encode(text[:stop])
    from_ = 0  # counted up to here
    while stop < len(text):
        wide = overlap
        while True:
            begin = max(from_, stop - wide)
            end = min(len(text), begin + max(chunk, 2 * wide))
            new_ids, new_at = encode(text[begin:end])
            new_at = new_at + begin
            joint = splice(text, (ids, at), (new_ids, new_at), begin, stop) if end > stop or end == len(text) else None
            if joint is not None:
                total += int(np.searchsorted(at, joint) - np.searchsorted(at, from_))
                ids, at, from_, stop = new_ids, new_at, joint, end
                break
            if begin == from_:  # the overlap is all that is not yet counted: encode it longer instead
                chunk = max(chunk, 2 * (stop - from_))
                end = min(len(text), from_ + chunk)
                ids, at = encode(text[from_:end])
                at, stop = at + from_, end
                break
            wide *= 2
    return total + len(at) - int(np.searchsorted(at, from_))


class Counter:
    """Token counts by one vocabulary; made in each task from the files' paths."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = tokenizer_path
        self._full = None
        self.plain = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, k in ranks.items():
                self.size[k] = len(token)

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
            self._full.no_truncation()
            self._full.no_padding()
        return self._full

    def encode_plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.plain.encode_ordinary(text), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.cumsum(self.size[ids]) - self.size[ids]
        return ids, character[starts] if len(ids) else starts

    def encode_full(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.full.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array([a for a, _ in found.offsets], np.int64)

    def counts(self, column: pa.Array) -> list[int]:
        data, offsets = flat(column)
        texts = [t or "" for t in column.to_pylist()]
        good = _PLAIN[data]
        good[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        good[:-1] &= ~((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        bad = np.r_[0, np.cumsum(~good)]
        plain = (bad[offsets[1:]] == bad[offsets[:-1]]) & (self.plain is not None)
        out = [0] * len(texts)
        short = []
        for i, text in enumerate(texts):
            if len(text) > CHUNK:
                out[i] = spliced_count(text, self.encode_plain if plain[i] else self.encode_full)
            elif plain[i]:
                out[i] = len(self.plain.encode_ordinary(text))
            else:
                short.append(i)
        if short:
            for i, found in zip(short, self.full.encode_batch([texts[i] for i in short], add_special_tokens=False)):
                out[i] = len(found.ids)
        return out


def token_counts(documents: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``tokenizer_path`` is a file of the ``tokenizers`` library; ``ranks_path`` and ``pattern`` (the same vocabulary as
    merge ranks, and its splitting pattern) make plain texts faster. The files must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            for part in pieces(batch):
                _, offsets = flat(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(counter.counts(part.column("text")), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

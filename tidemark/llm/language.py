"""Language identification of mixed-language texts: script ranges, word scores, Viterbi spans.

A bounded sample of labelled texts (``per_language`` documents of each language, chosen by hash, none
longer than ``max_train_bytes``) gives a table of log likelihoods for hashed byte trigrams, and the
scripts that each language is written in. In a text, the script of a word (by code point ranges)
narrows the languages that it can be in, its trigrams score those, and the Viterbi path over all
words, with a penalty for each switch, labels every word. Equal labels in a row are a span. The
language with the most letters is the document's; its share of the letters is the score.

Prediction is one pass over the texts without a shuffle. Whole texts are labelled. Null texts and
texts without a letter are ``und`` with score 0. Ties go to the language that sorts first. Repeated
rows are labelled one by one. Without any labelled text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flat import flat, pieces, table
from .quality import is_held_out

PER_LANGUAGE, MAX_TRAIN_BYTES, MAX_LANGUAGES = 300, 1 << 16, 256
BUCKETS = 1 << 15
SWITCH = 8.0
CAP = 12.0
FOREIGN = -1e4
SCORED_BYTES = 8 << 20
MIN_SCRIPT_SHARE = 0.01

#: First code point and name of script ranges; a range lasts until the next one begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
NAMES = sorted({n for _, n in SCRIPTS})
_FROM = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])
_LETTER = table((0x61, 0x7A), (0x80, 0xFF))


class Text:
    """Words (runs of ASCII letters and other characters beyond ASCII) of some rows, each row between two blanks."""

    def __init__(self, column: pa.Array):
        data, offsets = flat(column)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        self.bytes = np.full(len(data) + n + 2, 32, np.uint8)
        self.bytes[np.arange(len(data)) + row + 1] = data
        b = self.bytes
        b[(b >= 65) & (b <= 90)] += 32
        capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[capital] += 32
        inside = _LETTER[b]
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.stop = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        edges = offsets + np.arange(n + 1) + 1
        self.first = np.searchsorted(self.start, edges)
        self.edges = edges

    def trigrams(self) -> np.ndarray:
        """Bucket of the three bytes around each byte (the first and last byte have none)."""
        b = self.bytes.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)

    def scripts(self) -> np.ndarray:
        """Script of the first character of each word."""
        b, s = self.bytes.astype(np.int64), self.start
        at = [b[np.minimum(s + k, len(b) - 1)] for k in range(3)]
        two, three = ((at[0] & 31) << 6) | (at[1] & 63), ((at[0] & 15) << 12) | ((at[1] & 63) << 6) | (at[2] & 63)
        code = np.where(at[0] < 0x80, at[0], np.where(at[0] < 0xE0, two, np.where(at[0] < 0xF0, three, 0x20000)))
        return np.where(code >= 0x20000, NAMES.index("other"), _SCRIPT[np.searchsorted(_FROM, code, side="right") - 1])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, allowed: np.ndarray):
        self.languages, self.weights, self.allowed = languages, weights, allowed  # allowed[script, language]

    def word_scores(self, text: Text) -> np.ndarray:
        if not len(text.start):
            return np.zeros((0, len(self.languages)), np.float32)
        each = self.weights[text.trigrams()]  # of byte i + 1
        pairs = np.stack([text.start - 1, text.stop - 1], axis=1).ravel()
        each = np.vstack([each, np.zeros((1, each.shape[1]), np.float32)])
        sums = np.add.reduceat(each, pairs, axis=0)[::2]
        return np.where(self.allowed[text.scripts()], np.clip(sums, -CAP, CAP), FOREIGN).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word of all rows; row i has the words ``first[i]:first[i + 1]``. All rows advance together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin = first[:-1][order]
    size = size[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # rows with a word number t
    best = np.zeros((active[0], scores.shape[1]), np.float64)
    final = np.zeros(len(order), np.int64)
    for t in range(int(size[0])):
        n = int(active[t])
        at = begin[:n] + t
        if t:
            if n < len(best):
                final[n : len(best)] = best[n:].argmax(axis=1)
                best = best[:n]
            top = best.argmax(axis=1)
            change = best[np.arange(n), top] - penalty
            stay = best >= change[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best = np.where(stay, best, change[:, None]) + scores[at]
        else:
            best = best + scores[at]
    final[: len(best)] = best.argmax(axis=1)
    now = final
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(active[t])
        at = begin[:n] + t
        if t + 1 < size[0]:
            more = int(active[t + 1])
            now[:more] = came[begin[:more] + t + 1, now[:more]]
        labels[at] = now[:n]
    return labels


def fit(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    counts = np.zeros((BUCKETS, len(languages)))
    written = np.zeros((len(NAMES), len(languages)))
    for k, language in enumerate(languages):
        text = Text(pa.array([t for t, own in zip(texts, labels) if own == language], pa.string()))
        near = _LETTER[text.bytes[1:-1]]
        counts[:, k] = np.bincount(text.trigrams()[near], minlength=BUCKETS)
        written[:, k] = np.bincount(text.scripts(), minlength=len(NAMES))
    smooth = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    weights = smooth - smooth.mean(axis=1, keepdims=True) if languages else smooth
    allowed = written >= MIN_SCRIPT_SHARE * np.maximum(1, written.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script that no language has rules nothing out
    return Model(languages, weights.astype(np.float32), allowed)


def trained(documents: DataFrame, per_language: int = PER_LANGUAGE, max_train_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """A model of the ``MAX_LANGUAGES`` most frequent languages, from ``per_language`` documents of each at most.

    Of several rows with one doc_id the smallest text is taken, so the bound holds for rows too.
    """
    known = documents.where(F.col("doc_id").isNotNull() & ~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    known = known.join(F.broadcast(frequent), "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang", F.row_number().over(order).alias("nth")).where(F.col("nth") <= per_language)
    texts = documents.where(F.octet_length("text") <= max_train_bytes).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen.select("doc_id", F.col("lang").alias("label"))), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # per_language of each
    rows = sorted(rows, key=lambda r: (r.label, r.doc_id, r.text))
    return fit([r.text for r in rows], [r.label for r in rows])


def labelled(column: pa.Array, model: Model) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each row; a span has its word range and language."""
    text = Text(column)
    labels = viterbi(model.word_scores(text), text.first) if model.languages else np.zeros(len(text.start), np.int16)
    size = text.stop - text.start
    n = max(1, len(model.languages))
    rows = len(text.first) - 1
    row = np.repeat(np.arange(rows), np.diff(text.first))
    letters = np.bincount(row * n + labels, size, rows * n).reshape(rows, n)
    cut = np.ones(len(labels) + 1, bool)
    cut[1:-1] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
    if not len(labels):
        cut[:] = False
    bounds = np.flatnonzero(cut)
    span_row = row[bounds[:-1]] if len(bounds) else np.zeros(0, int)
    spans_from = np.searchsorted(span_row, np.arange(rows + 1))
    ascii_letter = np.add.reduceat(np.r_[(text.bytes >= 97) & (text.bytes <= 122), False].astype(np.int64), text.edges) if rows else []
    values = column.to_pylist()
    for i in range(rows):
        has = model.languages and letters[i].sum() > 0 and (ascii_letter[i] > 0 or any(c.isalpha() for c in values[i]))
        if not has:
            yield "und", 0.0, []
            continue
        k = int(letters[i].argmax())
        spans = [
            {"first": int(bounds[j] - text.first[i]), "last": int(bounds[j + 1] - text.first[i]), "lang": model.languages[labels[bounds[j]]]}
            for j in range(spans_from[i], spans_from[i + 1])
        ]
        yield model.languages[k], float(letters[i, k] / letters[i].sum()), spans


SPANS = "array<struct<first: long, last: long, lang: string>>"


def language_spans(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans are [first, last) ranges of words with their language."""
    model = model or trained(documents)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, size=SCORED_BYTES):
                found = list(labelled(part.column("text"), model))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], kind)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, spans {SPANS}")


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row."""
    return language_spans(documents).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))

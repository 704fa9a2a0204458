"""Awkward documents, and brute-force answers to the operators' questions about them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

PASSAGE = " ".join(f"passage{k} of shared words number{k}" for k in range(14))
BASE = " ".join(f"token{k} stands here" for k in range(60))
LONG = " ".join(f"w{k % 977} x{k % 31}" for k in range(30_000))
PERIODIC = "abcabc " * 200
ITEM = "the quick brown fox jumps over the lazy dog and then runs away from here"

DOCUMENTS = [
    (1, BASE, "en"),
    (2, BASE, "en"),
    (3, BASE.replace("token7 ", "changed "), "en"),
    (4, f"alpha beta gamma. {PASSAGE} one two three", "en"),
    (5, f"quite another start, {PASSAGE}", "de"),
    (6, None, "de"),
    (7, "", None),
    (8, "   \n\t ", "en"),
    (9, "only four words here", "en"),
    (10, "Only FOUR words here", None),
    (11, LONG, "en"),
    (12, PERIODIC, "fr"),
    (13, f"Prefix, {ITEM.upper()}! And more.", "en"),
    (14, f"{ITEM} {' '.join(ITEM.split()[3:])}", "en"),
    (15, "short words", "es"),
    (16, "Released under the MIT License. See also the Apache license, general public license", "en"),
    (17, "Émile Zürich ÑANDÚ naïve", "fr"),
    (18, "日本語のテキスト мир 123", None),
    (None, "a row without an id that has some words", "en"),
    (19, "the same row twice, word for word, is two rows", "en"),
    (19, "the same row twice, word for word, is two rows", "en"),
    (20, "<|endoftext|> is special  \n\n  here", "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens int, tag string, comp long"


def frame(spark, rows=DOCUMENTS):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 9.0, 7, "x", 3) for i, t, lang in rows], SCHEMA)


def lower(text: str | None) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def plain_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_groups(rows) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of rows with an id."""
    rows = [(i, shingle_set(t)) for i, t, _ in rows if i is not None]
    group = {k: k for k in range(len(rows))}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, (_, s) in enumerate(rows):
        for b in range(a):
            t = rows[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(rows))


def repeats(rows, length: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                for x in range(max(k, end), k + length):
                    gone[x] = 1
                end = k + length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def contaminated(rows, items: list[tuple[str, str]], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)."""
    phrases = []
    for item, text in items:
        w = plain_words(text)
        phrases += [(item, tuple(w[k : k + window])) for k in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for i, t, _ in rows:
        w = plain_words(t)
        hit, found = set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(item)
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)

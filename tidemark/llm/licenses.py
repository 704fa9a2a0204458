"""License scans by diagonal voting, in DataFrame expressions only.

Every license phrase and notice is a template: a sequence of words. All rolling pairs of words of a
text are hashed and joined with the pairs of the templates; a hit votes for its diagonal, the
difference of its positions in text and template. Votes are added up by (document, template,
diagonal). A diagonal with all pairs of a template is a place where it stands word for word. For the
longer notices neighbouring diagonals (an inserted or dropped word shifts the rest by one) are merged,
and each such place is verified: in a stretch of the text no longer than ``STRETCH`` allows, the pairs that
rise in the text and in the notice at once, each pair of the notice counted once, must be ``SHARE`` of the
notice's pairs. So words that merely recur, or stand in another order, verify nothing.

The templates are fixed and few, so the join is a broadcast; of the exploded pairs only hits, and one
row for each document, are shuffled. What is gathered for a document is bounded by its text.

Words: A-Z in lower case, runs of digits, letters and characters beyond ASCII. Null texts count as
empty: no words, no labels (empty strings), score 0. Rows that repeat doc_id and text are returned one
by one, with equal results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (label, words) of the phrases that count as license mentions wherever they stand.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: Fixed values: (label, wording) of notices that are found even with some words changed.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3  # diagonals at most so far apart are neighbours
SHARE = 0.7  # of a notice's pairs
STRETCH = 1.5  # times the notice's pairs, and one: the longest span, in pairs


def _pairs(words: Column) -> Column:
    """Each word with the next one (the last with null), as structs."""
    following = F.slice(words, F.lit(2), F.size(words))
    return F.arrays_zip(words.alias("word"), following.alias("next"))


def _pair_hash() -> Column:
    return F.when(F.col("pair.next").isNotNull(), F.xxhash64("pair.word", "pair.next"))


def _words(text: str) -> Column:
    """An empty word, the words of the text, and another empty one if it ends with a separator."""
    lower = F.translate(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit(""))), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(lower, SEPARATORS)


def templates(spark: SparkSession) -> DataFrame:
    """(hash, template, label, exact, pairs, place): one row for each pair of words of each template."""
    rows = [(k, label, k < len(PHRASES), words.split()) for k, (label, words) in enumerate(PHRASES + NOTICES)]
    every = spark.createDataFrame(rows, "template int, label string, exact boolean, words array<string>")
    pairs = every.select("template", "label", "exact", (F.size("words") - 1).alias("pairs"), F.posexplode(_pairs(F.col("words"))).alias("place", "pair"))
    return pairs.select("template", "label", "exact", "pairs", "place", _pair_hash().alias("hash")).where("hash IS NOT NULL")


HIT = "struct<label: string, exact: boolean, pairs: int, template: int, diagonal: int, votes: int, met: array<struct<at: int, turned: int>>>"
CHAIN = "struct<n: int, first: int, last: int>"


def _merged(hits: Column) -> Column:
    """Sorted diagonals of inexact templates, neighbours merged."""
    start = F.array().cast(f"array<{HIT}>")

    def step(held: Column, hit: Column) -> Column:
        last = F.element_at(held, -1)
        near = (F.size(held) > 0) & (last["template"] == hit["template"]) & (hit["diagonal"] - last["diagonal"] <= GAP)
        joined = F.struct(
            *[hit[c].alias(c) for c in ("label", "exact", "pairs", "template", "diagonal")],
            (last["votes"] + hit["votes"]).alias("votes"),
            F.concat(last["met"], hit["met"]).alias("met"),
        )
        return F.when(near, F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(hit)))

    return F.aggregate(F.filter(hits, lambda h: ~h["exact"] & (h["votes"] >= 2)), start, step)


def _longest(met: Column, pairs: Column) -> Column:
    """The longest chain of sorted hits that rises in text and template at once: (n, first, last) with places in the text."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last")).cast(CHAIN)

    def step(best: Column, hit: Column) -> Column:  # best[p]: the longest chain up to now that ends with the template's pair p
        place = -hit["turned"]
        before = F.coalesce(F.array_max(F.slice(best, F.lit(1), place)), none)
        longer = F.struct(
            (before["n"] + 1).alias("n"), F.when(before["n"] > 0, before["first"]).otherwise(hit["at"]).alias("first"), hit["at"].alias("last")
        ).cast(CHAIN)
        return F.transform(best, lambda b, p: F.when((p == place) & (longer > b), longer).otherwise(b))

    return F.array_max(F.aggregate(met, F.array_repeat(none, pairs), step))


def _verified(hit: Column) -> Column:
    """The longest chain of a merged diagonal within any stretch of the allowed length; null where none is long enough."""
    met, length = F.array_sort(hit["met"]), F.floor(hit["pairs"] * STRETCH + 1).cast("int")
    stretches = F.transform(
        F.array_distinct(F.transform(met, lambda h: h["at"])),
        lambda at: F.filter(met, lambda h: (h["at"] >= at) & (h["at"] < at + length)),
    )
    full = F.filter(stretches, lambda s: F.size(s) >= hit["pairs"] * SHARE)
    best = F.array_max(F.transform(full, lambda s: _longest(s, hit["pairs"])))
    return F.when(best["n"] >= hit["pairs"] * SHARE, best)


def _spans(hits: Column) -> Column:
    found = F.transform(_merged(hits), lambda h: F.struct(h["label"].alias("label"), h["pairs"].alias("pairs"), _verified(h).alias("chain")))
    return F.transform(
        F.filter(found, lambda f: f["chain"].isNotNull()),
        lambda f: F.struct(
            f["label"].alias("label"),
            f["chain"]["first"].cast("long").alias("first"),
            (f["chain"]["last"] + 1).cast("long").alias("last"),
            (f["chain"]["n"] / f["pairs"]).alias("share"),
        ),
    )


def license_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, spans) of every row.

    ``places``: (label, first, last) word ranges where a phrase stands, inclusive. ``spans``: (label, first, last, share)
    of the notices, ``share`` of their pairs found.
    """
    rows = documents.select("doc_id", F.xxhash64("text").alias("tag"), _words("text").alias("words"))
    empty_last = (F.get("words", F.size("words") - 1) == "").cast("int")
    rows = rows.select("doc_id", "tag", (F.size("words") - 1 - empty_last).alias("n"), F.posexplode(_pairs(F.col("words"))).alias("at", "pair"))
    met = rows.select("doc_id", "tag", "n", "at", _pair_hash().alias("hash")).join(F.broadcast(templates(documents.sparkSession)), "hash", "left")
    # the pair before the first word, which no template has, stands for the document itself
    met = met.where("at = 0 OR template IS NOT NULL").withColumn("row", (F.col("at") == 0).cast("int")).withColumn("at", F.col("at") - 1)
    # a hit as (at, -place): hits of one place in the text come with falling places of the template, so that a chain takes one
    place = F.struct("at", (-F.col("place")).alias("turned"))
    votes = met.groupBy("doc_id", "tag", "n", "template", "label", "exact", "pairs", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set(F.when(F.col("template").isNotNull(), place)).alias("met"), F.sum("row").alias("rows")
    )
    votes = votes.withColumn("votes", F.size("met"))  # equal rows of a document vote once
    hit = F.when(F.col("template").isNotNull(), F.struct("label", "exact", "pairs", "template", "diagonal", "votes", "met").cast(HIT))
    each = votes.groupBy("doc_id", "tag", "n").agg(
        F.sum("rows").alias("copies"),
        F.array_sort(F.collect_list(hit), lambda a, b: F.when(a["template"] != b["template"], a["template"] - b["template"]).otherwise(a["diagonal"] - b["diagonal"])).alias("hits"),
    )
    places = F.transform(
        F.filter("hits", lambda h: h["exact"] & (h["votes"] == h["pairs"])),
        lambda h: F.struct(h["label"].alias("label"), h["diagonal"].cast("long").alias("first"), (h["diagonal"] + h["pairs"]).cast("long").alias("last")),
    )
    found = each.select("doc_id", F.col("n").cast("long").alias("n_words"), "copies", places.alias("places"), _spans(F.col("hits")).alias("spans"))
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copy", "copies")


def license_labels(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; score is 1 with any phrase, else the best share."""
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))
    starts = F.transform("places", lambda p: p["first"])
    return license_spans(documents).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )

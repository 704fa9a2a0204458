"""Soft-membership mixing: document rates with which the domains reach target shares of tokens.

1. A naive Bayes classifier over hashed words is fitted on a bounded sample of a labelled table
   (``per_domain`` documents of each domain, chosen by hash) and gives every document a posterior over
   the domains of the targets. The words of a text are not independent, so their evidence is scaled by
   ``weight * words ** -power``; both numbers are those of ``SCALES`` with the least log loss on as many other
   labelled documents, which the classifier has not seen. Without such documents evidence counts as it is.
2. The rates start at 1. Projected gradient steps on the weighted squares of (expected tokens of a
   domain - target) move them, never below 0. A step needs one sum for each domain over all
   documents; only these sums reach the driver. With the expected tokens at rate 1 as weights, and
   each document's step divided by its tokens, a step of 1 can never overshoot (the Hessian is
   dominated by its row sums). Momentum, dropped whenever the distance grows, shortens the way.

Everything is DataFrame expressions. The weights of a domain are an array of ``BUCKETS`` numbers in the
plan, and a text's words are summed up within its row: scoring is one pass without a shuffle.

Documents without words (null and empty texts too) get the prior as posterior and keep what rate it
leads to. Repeated rows count and are returned one by one. Labels outside the targets, null labels and labels of
unknown documents are ignored. A target that no posterior can reach is approached as far as
rates of 0 and more allow. Without any labelled document all posteriors are equal. Rates are finite: steps end at
``TOLERANCE`` or after ``STEPS``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

BUCKETS = 8192
PER_DOMAIN = 400
MAX_SAMPLE_BYTES = 1 << 16
#: (weight, power) that are tried: from all words as independent to one word's evidence for any length.
SCALES = [(w, p) for p in (0.0, 0.25, 0.5, 0.75, 1.0) for w in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)]
SMOOTHING = 0.5
STEPS = 60
FOLD = 5  # steps between two written tables of rates
STALL = 1e-12  # gain of a step, in tokens, from which on nothing is gained
TOLERANCE = 1e-6  # of all tokens, within which every domain must reach its target


def word_list(text: str = "text") -> Column:
    """The words, with an empty one at an end where white space stands."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\r\\n]+")


def word_count(words: str) -> Column:
    """Number of words of a ``word_list``, without the empty ones."""
    first, last = F.get(words, F.lit(0)) == "", F.get(words, F.size(words) - 1) == ""
    return F.greatest(F.lit(0), F.size(words) - first.cast("int") - last.cast("int")).cast("long")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _array(values: list[float]) -> Column:
    """A constant array; written as one string, which the optimizer turns into a literal."""
    return F.split(F.lit(",".join(f"{x:.7g}" for x in values)), ",").cast("array<double>")


def sampled(labelled: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN) -> DataFrame:
    """(doc_id, domain, held_out): at most ``per_domain`` labelled documents of each domain to learn from and as many to calibrate with."""
    known = labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain")
    order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    nth = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * per_domain)
    return nth.select("doc_id", "domain", (F.col("nth") % 2 == 0).alias("held_out"))


def word_weights(documents: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN) -> tuple[list[list[float]], list[float]]:
    """For each domain the centred log likelihoods of the hashed words (empty or unseen: 0), and the priors of the domains."""
    known = labelled.where(F.col("domain").isin(domains))
    counts = {r.domain: r.n for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) + len(domains)
    priors = [float((counts.get(d, 0) + 1) / total) for d in domains]
    chosen = sampled(labelled, domains, per_domain).where("NOT held_out")
    texts = documents.where(F.octet_length("text") <= MAX_SAMPLE_BYTES).select("doc_id", "text")
    words = texts.join(F.broadcast(chosen), "doc_id").select("domain", F.explode(word_list()).alias("word")).where("word <> ''")
    seen = words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(
        *[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    )
    counts = seen.collect()  # a row for each bucket at most
    totals = [sum(r[f"c{k}"] for r in counts) + SMOOTHING * BUCKETS for k in range(len(domains))]
    weights = [[0.0] * BUCKETS for _ in domains]
    for r in counts:
        logs = [math.log((r[f"c{k}"] + SMOOTHING) / t) for k, t in enumerate(totals)]
        for k, x in enumerate(logs):
            weights[k][r.bucket] = x - sum(logs) / len(logs)
    return weights, priors


def _evidence(documents: DataFrame, weights: list[list[float]], *columns: str) -> DataFrame:
    """The given columns, tokens, and s0, s1, ...: the summed word weights of every row."""
    rows = documents.select(*columns, word_list().alias("words"))
    rows = rows.select(*columns, word_count("words").alias("tokens"), F.transform("words", _bucket).alias("buckets"))

    def evidence(values: list[float]) -> Column:
        array = _array(values)
        return F.aggregate("buckets", F.lit(0.0), lambda total, bucket: total + F.get(array, bucket))

    return rows.select(*columns, "tokens", *[evidence(w).alias(f"s{k}") for k, w in enumerate(weights)])


def _logits(priors: list[float], weight: Column, power: Column) -> list[Column]:
    share = weight * F.pow(F.greatest(F.lit(1), F.col("tokens")).cast("double"), -power)
    return [F.col(f"s{k}") * share + math.log(p) for k, p in enumerate(priors)]


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def calibrated(documents: DataFrame, labelled: DataFrame, domains: list[str], weights: list[list[float]], priors: list[float], per_domain: int = PER_DOMAIN) -> tuple[float, float]:
    """The (weight, power) of ``SCALES`` with the least log loss on held-out labelled documents; (1, 0) without any."""
    held = sampled(labelled, domains, per_domain).where("held_out").select("doc_id", "domain")
    texts = documents.where(F.octet_length("text") <= MAX_SAMPLE_BYTES).select("doc_id", "text").join(F.broadcast(held), "doc_id")
    scores = staged(_evidence(texts, weights, "domain"), "held-out")
    scales = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weight"), F.lit(p).alias("power")) for k, (w, p) in enumerate(SCALES)]))
    rows = scores.select("*", scales.alias("scale"))
    logits = rows.select("domain", "scale.k", *[z.alias(f"z{k}") for k, z in enumerate(_logits(priors, F.col("scale.weight"), F.col("scale.power")))])
    z = [F.col(f"z{k}") for k in range(len(domains))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    own = _total([F.when(F.col("domain") == d, x).otherwise(0.0) for d, x in zip(domains, z)])
    loss = top + F.log(_total([F.exp(x - top) for x in z])) - own
    found = logits.select("k", loss.alias("loss")).groupBy("k").agg(F.sum("loss").alias("loss")).collect()  # a row for each scale
    return SCALES[min((r.loss, r.k) for r in found)[1]] if found else (1.0, 0.0)


def posteriors(documents: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN) -> DataFrame:
    """(doc_id, tag, tokens, p0, p1, ...) of every row; ``tag`` is xxhash64(text)."""
    weights, priors = word_weights(documents, labelled, domains, per_domain)
    scale = calibrated(documents, labelled, domains, weights, priors, per_domain)
    n = len(domains)
    rows = documents.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    sums = _evidence(rows, weights, "doc_id", "tag")
    logits = sums.select("doc_id", "tag", "tokens", *[z.alias(f"z{k}") for k, z in enumerate(_logits(priors, *map(F.lit, scale)))])
    top = F.greatest(*[F.col(f"z{k}") for k in range(n)]) if n > 1 else F.col("z0")
    shifted = logits.select("doc_id", "tag", "tokens", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in range(n)])
    norm = _total([F.col(f"e{k}") for k in range(n)])
    return shifted.select("doc_id", "tag", "tokens", *[(F.col(f"e{k}") / norm).alias(f"p{k}") for k in range(n)])


def fitted(members: DataFrame, shares: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """``members`` (p0, p1, ..., tokens) with a column ``rate``, and the expected tokens of the domains at these rates."""
    n = len(shares)
    def expected(rated: DataFrame) -> list[float]:
        row = rated.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p{k}")), F.lit(0.0)) for k in range(n)]).first()
        return [float(x) for x in row]

    def distance(totals: list[float]) -> float:
        return sum((e - t) ** 2 / w for e, t, w in zip(totals, target, first) if w > 0)

    rated = members.withColumn("rate", F.lit(1.0)).withColumn("earlier", F.lit(1.0))
    now = before = first = expected(rated)
    target = [s * sum(first) / sum(shares) for s in shares]
    pace = 1.0
    for step in range(1, steps + 1):
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / following, following
        ahead = [e + momentum * (e - b) for e, b in zip(now, before)]  # totals are linear in the rates
        move = [(e - t) / w if w > 0 else 0.0 for e, t, w in zip(ahead, target, first)]
        change = reduce(lambda a, b: a + b, [F.col(f"p{k}") * F.lit(m) for k, m in enumerate(move)])
        moved = F.col("rate") + momentum * (F.col("rate") - F.col("earlier")) - change
        rated = rated.select(*members.columns, F.greatest(F.lit(0.0), moved).alias("rate"), F.col("rate").alias("earlier"))
        if step % FOLD == 0:
            rated = staged(rated, "rates")
        before, now = now, expected(rated)
        if distance(now) > distance(before):
            pace = 1.0  # begin anew without momentum
        reached = max(abs(a - t) for a, t in zip(now, target)) <= tolerance * max(1.0, sum(first))
        if reached or abs(distance(before) - distance(now)) <= STALL * max(1.0, sum(first)):
            break
    rated = rated.drop("earlier")
    return rated, now


def _rated(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int) -> DataFrame:
    domains = sorted(targets)
    members = staged(posteriors(documents, labelled, domains, per_domain), "members")
    rated, _ = fitted(members, [targets[d] for d in domains])
    columns = [F.col(f"p{k}") for k in range(len(domains))]
    top = F.greatest(*columns) if len(domains) > 1 else columns[0]
    fraction = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor("rate")
    return rated.select(
        "doc_id",
        "tag",
        "tokens",
        F.coalesce(*[F.when(p == top, F.lit(d)) for p, d in zip(columns, domains)]).alias("domain"),
        F.map_from_arrays(F.array(*map(F.lit, domains)), F.array(*columns)).alias("membership"),
        "rate",
        (whole + (fraction < F.col("rate") - whole).cast("long")).alias("draws"),
    )


ADDED = ["tokens", "domain", "membership", "rate", "draws"]


def mixed(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = PER_DOMAIN) -> DataFrame:
    """The documents, with all their columns, and tokens, domain (the likeliest), membership (map), rate and draws.

    ``labelled`` has (doc_id, domain), ``targets`` the share of tokens for each domain. ``draws`` is the rate as a
    whole number of copies for one epoch, rounded up for the part of documents (by hash) that the fraction says.
    Columns of ``documents`` with these names are replaced.
    """
    rated = _rated(documents, labelled, targets, per_domain)
    facts = rated.dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", F.struct(*ADDED).alias("added"))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_tag"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_tag") == F.col("tag"))
    kept = [F.col(f"row.`{c}`") for c in documents.columns if c not in ADDED]
    return rows.join(facts, same).select(*kept, *[F.col(f"added.{c}") for c in ADDED])


def rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = PER_DOMAIN) -> DataFrame:
    """(doc_id, tokens, domain, membership, rate, draws) of every row; no text is shuffled for this."""
    return _rated(documents, labelled, targets, per_domain).select("doc_id", *ADDED)

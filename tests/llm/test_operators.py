"""The operators against brute force on awkward rows: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import BASE, DOCUMENTS, ITEM, LONG, SCHEMA, contaminated, frame, near_groups, plain_words, repeats

from tidemark.llm import components, contamination, jaccard, language, licenses, mixing, quality, suffixes, tokens, urls, vectors
from tidemark.llm.queries import RULES, URL_SQL

IDS = sorted([i for i, _, _ in DOCUMENTS], key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------


def test_language_of_mixed_and_empty_texts(spark, docs, empty):
    en, de, ru = "the house and the garden of this town ", "das haus und der garten in dieser stadt ", "дом и сад этого города "
    train = [(3 * k, (en, de, ru)[k % 3] * 4, ("en", "de", "ru")[k % 3]) for k in range(90)]
    model = language.trained(frame(spark, train))
    texts = [(1, en, None), (2, de * 2, None), (3, en * 3 + de * 2, None), (4, "город", None), (5, None, None), (6, "12 !?", None), (7, "", None)]
    found = {r.doc_id: r for r in language.language_spans(frame(spark, texts), model).collect()}
    assert [found[k].lang_pred for k in range(1, 8)] == ["en", "de", "en", "ru", "und", "und", "und"]
    assert [s.lang for s in found[3].spans] == ["en", "de"] and found[3].spans[0].last == found[3].spans[1].first == 24
    assert found[5].score == 0 and all(0 <= r.score <= 1 for r in found.values())
    assert sorted((r.doc_id for r in language.languages(docs).collect()), key=repr) == IDS
    assert language.languages(empty).collect() == []


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    texts = [(k % 4, f"text {k} of these words", "en" if k % 4 < 2 else "de") for k in range(200)] + [(None, "no id at all", "en")]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] + [(None, 1)], "doc_id long, quality int")
    known = quality.learnable(labels)
    got = {(r.doc_id, r.text, r.label) for r in quality.sample(docs, known).collect()}
    assert got == {(r.doc_id, min(t for i, t, _ in texts if i == r.doc_id), r.label) for r in known.collect()}
    held = []
    monkeypatch.setattr(language, "fit", lambda texts, labels: held.append((texts, labels)))
    language.trained(docs)
    assert len(held[0][0]) == len({i for i, _, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 3 != 1})
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    language.trained(docs.unionByName(frame(spark, [(9, "más", "es")])))
    usable = [lang for i, _, lang in texts if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    assert set(held[1][1]) == {max(sorted(set(usable)), key=usable.count)}
    shown = {r[0]: r[1] for r in docs.select("doc_id", quality.is_held_out()).distinct().collect()}
    assert shown == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in (0, 1, 2, 3, None)}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = [5, 0, 7, 1, 6]
    scores = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    first = np.r_[0, np.cumsum(sizes)]
    labels = language.viterbi(scores, first, 2.0)

    def value(s, path):
        return sum(s[k, x] for k, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    import itertools

    for low, high in zip(first[:-1], first[1:]):
        s = scores[low:high]
        best = max((value(s, p) for p in itertools.product(range(3), repeat=int(high - low))), default=0)
        assert value(s, labels[low:high]) == pytest.approx(best, abs=1e-4)


# 2 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [contamination.PHRASES, 12])
def test_contamination_is_brute_force(spark, docs, limit):
    items = [(5, ITEM), (5, ITEM), (6, "short words"), (7, None), (8, "..."), (None, "only four words here"), (9, " ".join(LONG.split()[5000:5015]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(contamination.contamination(docs, bench, limit), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = contaminated(DOCUMENTS, [(str(i), t) for i, t in items if i is not None])
    assert got == [(i, n, h, len(x.split(",")) if x else 0, hashlib.sha256(x.encode()).hexdigest(), h > 0) for i, n, h, x in want]


def test_cleaning_leaves_no_phrase_and_clean_texts_alone(spark, docs, empty):
    bench = spark.createDataFrame([(5, ITEM), (6, "short words")], "item_id long, text string")
    joined = frame(spark, [(1, f"{' '.join(ITEM.split()[:7])} {ITEM} {' '.join(ITEM.split()[7:])}", None)])  # a cut joins a new phrase
    clean = contamination.decontaminated(docs.unionByName(joined), bench)
    assert clean.columns == docs.columns
    assert contamination.contamination(clean, bench).where("contaminated").count() == 0
    texts = {(i, t) for i, t in rows(clean, "doc_id", "text")}
    assert all((i, t) in texts for i, t, _ in DOCUMENTS if i not in (13, 14, 15))
    assert contamination.contamination(empty, bench).collect() == []
    assert contamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_cleaning_does_not_depend_on_the_blocks(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(12)]
    context = " ".join(a[:12])
    items = [(1, f"{context} what is it"), (2, f"{context} who was that then"), (3, " ".join(b)), (4, "mean short words"), (5, "x1 x2"), (6, "x2 x3")]
    given = [
        (1, f"Before. {context} who was that then, after", None),  # overlapping items
        (2, f"{' '.join(b[:6])} x1 x2 x3 {' '.join(b[6:])} end", None),  # a cut joins a phrase of another block
        (3, f"mean x1 x2 short {' '.join(b)} words mean short", None),
        (3, f"mean x1 x2 short {' '.join(b)} words mean short", None),
        (4, f"{' '.join(b[:5])} mean x2 x3 short words {' '.join(b[5:])}", None),
        (5, None, None),
        (None, "x1 x2 x3", None),
    ]
    docs, bench = frame(spark, given), spark.createDataFrame(items, "item_id long, text string")
    whole = rows(contamination.decontaminated(docs, bench), *docs.columns)
    for limit in (12, 3):
        assert rows(contamination.decontaminated(docs, bench, limit), *docs.columns) == whole
    assert [r[1].split() if r[1] else r[1] for r in whole][:2] == [["Before.", ",", "after"], ["end"]]


def test_blocks_are_collected_one_at_a_time(spark, docs, monkeypatch):
    item = " ".join(LONG.split()[3000:3400])  # one item of many blocks
    bench = spark.createDataFrame([(1, item), (2, "short words")], "item_id long, text string")
    sizes = [len(p.length) for p in contamination.PhraseBlocks(bench, 100)]
    assert len(sizes) > 3 and max(sizes) < 300 and sum(sizes) == 400 - 9 + 1
    held, most, init = [], [], contamination.Phrases.__init__

    def counted(self, *a):
        import gc
        import weakref

        gc.collect()
        held.append(weakref.ref(self))
        most.append(sum(x() is not None for x in held))
        init(self, *a)

    monkeypatch.setattr(contamination.Phrases, "__init__", counted)
    got = rows(contamination.contamination(docs, bench, 200), "doc_id", "n_hit")
    assert got == sorted(((i, n) for i, _, n, _ in contaminated(DOCUMENTS, [("1", item), ("2", "short words")])), key=repr)
    assert max(most) <= 2  # the one made and the one whose pass was just written


def test_index_finds_all_places():
    rng = random.Random(5)
    for _ in range(30):
        text = [rng.choice([0, 1, 1, 2, 3]) for _ in range(120)]
        phrase = [rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 4))]
        p = contamination.Phrases([("a", phrase)], 4)
        number = {int(h): k + 1 for k, h in enumerate(p.vocabulary)}
        symbols = np.array([number.get(x, 0) for x in text], np.int32)
        _, starts = p.find(symbols, np.array([0, 60]))
        want = [k for k in range(len(text) - len(phrase) + 1) if text[k : k + len(phrase)] == phrase and not k < 60 < k + len(phrase)]
        assert sorted(starts.tolist()) == want


# 3 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    P = pytest.importorskip("public_tokenizers")
    return tokens.Counter(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_spliced_counts_are_exact(counter):
    rng = random.Random(2)
    texts = [LONG[:9000], "a" * 3000, " " * 900, "  \n x  " * 300, "日本語 テキスト " * 200, "hi <|endoftext|> you " * 90, "é×÷ e" * 300]
    texts += ["".join(rng.choice(" ab\n'é　日.1🙂<|") for _ in range(1500)) for _ in range(8)]
    for text in texts:
        want = len(counter.full.encode(text, add_special_tokens=False).ids)
        assert counter.counts(pa.array([text])) == [want]
        for chunk, overlap in ((300, 16), (64, 5)):
            assert tokens.spliced_count(text, counter.encode_full, chunk, overlap) == want
            if "|" not in text and text.isascii():
                assert tokens.spliced_count(text, counter.encode_plain, chunk, overlap) == want


def test_token_counts_of_all_rows(docs, empty, counter):
    P = pytest.importorskip("public_tokenizers")
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = [(i, len((t or "").encode()), len(counter.full.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in DOCUMENTS]
    assert rows(tokens.token_counts(docs, *args), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 512) for w in want), key=repr)
    assert tokens.token_counts(empty, *args).collect() == []


# 4 ------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet")
    scored = quality.quality_scores(read("documents"), read("labels")).where("held_out").join(read("labels"), "doc_id")
    right = scored.selectExpr("avg(int(predicted = quality)) a", "avg(if(quality = 1, predicted, null)) k").first()
    assert right.a > 0.98 and right.k > 0.99


def test_quality_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1), (5, 0), (99, 1), (None, 1), (6, None)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert sorted((r.doc_id for r in found), key=repr) == IDS and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).collect() == []
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_gradients_are_the_slopes_of_the_loss():
    net = quality.Network(3)
    texts = [b"some words here " * 40, b"x!! y!! " * 9]
    made = [quality.chunked(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    chunks, row = np.concatenate(made), np.repeat([0, 1], [len(m) for m in made])
    label, weight = np.array([1.0, 0.0]), np.array([1.0, 0.5])

    def loss():
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        p = net.scores(data, ends, net.pair_tables())
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean()

    for p, g in zip(net.parameters(), net.gradients(chunks, row, label, weight)):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-4)


# 5 ------------------------------------------------------------------------------------------------


def test_license_places(docs, empty):
    phrases = [(label, p.encode().split()) for label, p in licenses.PHRASES]
    want = []
    for i, t, _ in DOCUMENTS:
        w = plain_words(t)
        at = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    found = licenses.license_labels(docs)
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert licenses.license_labels(empty).collect() == []


def test_changed_notice_is_found_and_scattered_words_are_not(spark):
    notice = licenses.NOTICES[1][1].split()
    changed = notice[:6] + ["verily"] + notice[6:9] + notice[10:]
    texts = [(1, "before " + " ".join(changed) + " after", None), (2, " filler and more of it ".join(notice), None), (3, "Licensed under the Apache License", None)]
    found = {r.doc_id: r for r in licenses.license_labels(frame(spark, texts)).collect()}
    assert found[1].labels == "bsd" and found[1].base_labels == "" and 0.7 <= found[1].score < 1
    assert found[2].labels == "" and found[2].score == 0
    assert found[3].labels == found[3].base_labels == "apache" and found[3].score == 1


def notices(words: list[str]) -> dict[str, float]:
    """The best share by label, with plain loops."""
    out: dict[str, float] = {}
    for label, wording in licenses.NOTICES:
        t = wording.split()
        pairs = list(zip(t, t[1:]))
        hits = [(at, p) for at, two in enumerate(zip(words, words[1:])) for p, pair in enumerate(pairs) if two == pair]
        diagonals = sorted(d for d in {at - p for at, p in hits} if sum(at - p == d for at, p in hits) >= 2)
        places: list[list[int]] = []
        for d in diagonals:
            if places and d - places[-1][-1] <= licenses.GAP:
                places[-1].append(d)
            else:
                places.append([d])
        for own in places:
            met = [h for h in hits if h[0] - h[1] in own]
            for low in {at for at, _ in met}:
                part = sorted(h for h in met if low <= h[0] < low + int(len(pairs) * licenses.STRETCH + 1))
                longest = [1] * len(part)
                for i, (at, p) in enumerate(part):
                    longest[i] = 1 + max((longest[j] for j in range(i) if part[j][0] < at and part[j][1] < p), default=0)
                share = max(longest) / len(pairs)
                if share >= licenses.SHARE:
                    out[label] = max(out.get(label, 0), share)
    return out


def test_notices_are_brute_force(spark):
    rng = random.Random(8)
    texts = ["licensed under a licensed under a licensed under a licensed under a", "Released under the \u212aMIT License, released under the mit license"]
    for k in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(licenses.NOTICES)[1].split()
            if rng.random() < 0.4:
                notice = notice[: len(notice) // 2] * rng.randint(1, 4)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randint(0, 1)] = [rng.choice(["x", "the", "license", "under"])] * rng.randint(0, 2)
                notice = notice or ["x"]
            words += notice + ["filler"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    found = licenses.license_spans(frame(spark, [(k, t, None) for k, t in enumerate(texts)] + [(0, texts[0], None)])).collect()
    assert len(found) == len(texts) + 1
    labelled = 0
    for r in found:
        best: dict[str, float] = {}
        for s in r.spans:
            best[s.label] = max(best.get(s.label, 0), s.share)
        want = notices([w.decode() for w in plain_words(texts[r.doc_id])])
        assert best == pytest.approx(want), texts[r.doc_id]
        labelled += bool(want)
    assert [r.spans for r in found if r.doc_id == 0] == [[], []] and 20 < labelled < len(texts)


# 6 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_near_groups_are_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rng = random.Random(block)
    words = [f"v{k}" for k in range(60)]
    more = []
    for k in range(60):
        text = words[:]
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"e{rng.randrange(20)}"
        more.append((100 + k, " ".join(text), None))
    every = DOCUMENTS + more
    found = jaccard.near_duplicates(frame(spark, every))
    got = [r for r in rows(found, "doc_id", "n_shingles", "component_id") if r[0] is not None]
    assert sorted(got) == near_groups(every)


def test_one_of_each_group_stays(docs, empty):
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in {r[2] for r in near_groups(DOCUMENTS)})
    assert jaccard.near_duplicates(empty).collect() == [] and jaccard.deduplicated(empty).collect() == []


def test_no_row_goes_with_a_repeated_one(spark):
    near = BASE.replace("token7 ", "changed ")
    given = [
        *DOCUMENTS,
        (None, "another row without an id, unlike the first", None),
        (None, "another row without an id, unlike the first", None),
        (None, BASE, None),  # equal to document 1
        (19, "a second text under the id of a repeated row", None),
        (30, near, None),  # goes with document 1
        (30, "another text of document 30 that is like nothing else", None),
        (31, None, None),
        (31, None, None),
        (31, "", None),
        (32, "Case  and white space", None),
        (32, "case and White space", None),
    ]
    got = sorted(((r.doc_id, (r.text or "").lower().split()) for r in jaccard.deduplicated(frame(spark, given)).collect()), key=repr)
    gone = {(2, BASE), (3, near), DOCUMENTS[4][:2], (10, "Only FOUR words here"), (None, BASE), (30, near), (32, "case and White space")}
    want = [(i, t) for i, t, _ in given if (i, t) not in gone]
    want.remove(DOCUMENTS[-2][:2])
    assert got == sorted(((i, (t or "").lower().split()) for i, t in want), key=repr)


def test_texts_of_one_doc_id_link_on_their_own(spark):
    other = " ".join(f"other{k} words" for k in range(60))
    given = [(3, BASE, None), (7, BASE.replace("token9 ", "x "), None), (7, other, None), (8, other.replace("other5 ", "y "), None)]
    found = rows(jaccard.near_duplicates(frame(spark, given)), "doc_id", "n_shingles", "component_id")
    assert found == near_groups(given) and [r[2] for r in found] == [3, 7, 3, 7]


def test_tree_connects_what_brute_force_connects():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        change = rng.random(40) < rng.choice([0, 0.05, 0.12, 0.3])
        s[change] = rng.integers(0, 200, change.sum())
        sets.append(np.unique(s))
    pairs = [(a, b) for a in range(40) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert components.forest(jaccard.linked(sets, [len(s) for s in sets])) == components.forest(pairs) or dict(
        components.forest(jaccard.linked(sets, [len(s) for s in sets]))
    ) == dict(components.forest(pairs))


# components ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [8, 400_000])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "FOREST_EDGES", limit)
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(200 + k, 201 + k) for k in range(20)] + [(500, 501 + k) for k in range(20)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges + [(7, 7), (None, 3)], "a long, b long")).collect()}
    want = dict(components.forest([e for e in edges if e[0] != e[1]]))
    assert {k: v for k, v in found.items() if k != v} == want


# 7 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [vectors.CELL, 6])
def test_near_vectors_are_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "FILL", 5)
    rng = np.random.default_rng(8)
    data = []
    for group in range(12):
        centre = rng.normal(size=24)
        data += [(centre + rng.normal(0, 0.14, 24) * rng.random()).astype(np.float32).tolist() for _ in range(12)]
    data += [data[0], data[0], [2 * x for x in data[1]]]
    table = [(k, v, k % 2 if k % 7 else None) for k, v in enumerate(data)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 0)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int")).collect()}
    e = np.array([v for _, v, _ in table], np.float64)
    cosine = e @ e.T / np.outer(np.linalg.norm(e, axis=1), np.linalg.norm(e, axis=1))
    label = np.array([-1 if x is None else x for _, _, x in table])
    link = (cosine >= 0.98) & (label[:, None] == label[None]) & (label[:, None] >= 0)
    np.fill_diagonal(link, False)
    root = dict(components.forest([(int(a), int(b)) for a, b in zip(*np.nonzero(link))]))
    assert link.sum() > 100
    assert {k: found[k] for k in range(len(table))} == {k: (int(link[k].sum()), root.get(k, k)) for k in range(len(table))}
    assert [found[k] for k in (900, 901, 902, 903, 904, 905)] == [(0, 900), (0, 901), (0, 902), (0, 903), (1, 904), (1, 904)]


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# 8 ------------------------------------------------------------------------------------------------


def test_rates_reach_the_targets(spark, empty):
    words = {"a": "apple pear plum", "b": "iron zinc lead", "c": "oak elm ash"}
    texts = [(k, " ".join(random.Random(k).choices(words["abbccc"[k % 6]].split(), k=5 + k % 40)), "abbccc"[k % 6]) for k in range(240)]
    texts += [(1000, None, None), (1001, "", "zz"), (0, texts[0][1], "a")]
    docs = frame(spark, texts)
    labelled = docs.selectExpr("doc_id", "lang AS domain").where("doc_id % 2 = 0")
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    found = mixing.rates(docs, labelled, shares).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _, _ in texts)
    total = sum(r.tokens for r in found)
    assert total == sum(len((t or "").split()) for _, t, _ in texts)
    for d, share in shares.items():
        assert sum(r.tokens * r.rate * r.membership[d] for r in found) == pytest.approx(share * total, rel=1e-3)
    assert all(r.rate >= 0 and abs(r.draws - r.rate) < 1 and sum(r.membership.values()) == pytest.approx(1) for r in found)
    right = [r.domain == t[2] for r in found for t in [next(t for t in texts if t[0] == r.doc_id)] if t[2] in shares]
    assert sum(right) / len(right) > 0.95
    mixed = mixing.mixed(docs, labelled, shares)
    assert mixed.count() == len(texts) and mixed.columns.count("tokens") == 1
    assert mixing.rates(empty, labelled.limit(0), shares).collect() == []


def test_evidence_is_calibrated_on_unseen_documents(spark):
    rng = random.Random(3)
    # three of four words say nothing, and the telling ones repeat within a document: naive Bayes is too sure
    texts = []
    for k in range(300):
        d = "ab"[k % 2]
        telling = rng.choice(["apple", "pear"] if rng.random() < (0.8 if d == "a" else 0.2) else ["iron", "zinc"])
        texts.append((k, " ".join([telling] * 10 + rng.choices(["the", "of", "and"], k=30)), d))
    docs = frame(spark, texts)
    labelled = docs.selectExpr("doc_id", "lang AS domain")
    domains = ["a", "b"]
    weights, priors = mixing.word_weights(docs, labelled, domains)
    scale = mixing.calibrated(docs, labelled, domains, weights, priors)
    sampled = {(r.doc_id, r.held_out) for r in mixing.sampled(labelled, domains, 40).collect()}
    assert len(sampled) == 160 and sum(h for _, h in sampled) == 80 and len({i for i, _ in sampled}) == 160
    found = mixing.posteriors(docs, labelled, domains).collect()
    sure = [max(r.p0, r.p1) for r in found]
    right = [(r.p0 > r.p1) == (r.doc_id % 2 == 0) for r in found]
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.06  # as sure as it is right
    assert scale != (1.0, 0.0)
    assert mixing.calibrated(docs, labelled.limit(0), domains, weights, priors) == (1.0, 0.0)


def test_projected_gradient_is_least_squares(spark):
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([1, 1, 1], 50), rng.integers(1, 90, 50)
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "tokens long, p0 double, p1 double, p2 double")
    rated, reached = mixing.fitted(members, [0.6, 0.3, 0.1], steps=100, tolerance=1e-5)
    rate = np.array([r.rate for r in rated.collect()])
    assert (rate >= 0).all() and np.allclose(reached, t.sum() * np.array([0.6, 0.3, 0.1]), rtol=1e-3)


# 9 ------------------------------------------------------------------------------------------------


LINKED = [
    (20, "https://one.org/a", '<link rel="canonical" href="two?x=1&amp;y=2#z"><meta http-equiv="refresh" content="5;URL=&quot;/three&quot;">'),
    (21, "https://one.org/two?x=1&y=2", '<link rel="shortcut" href="https://no.net/"><LINK HREF=//four.net/q REL=CANONICAL>'),
    (22, "https://one.org/three#top", None),
    (23, "https://FOUR.net/q", ""),
    (24, "https://five.org/fr/", '<link rel="canonical" href="https://one.org/a">'),
    (25, "https://six.org/x/y", '<link rel="canonical" href="?q">'),
    (26, "https://six.org/x/y?q", '<link rel="canonical" href="#here"><link rel=canonical href="https://seven.com/de/">'),
    (27, "https://seven.com/de/", '<link rel="canonical" href="https://example.com/de/0">'),
    (None, "https://six.org/x/y", None),
]


def test_blocks_follow_redirects(spark):
    pages = [
        (1, "https://a.example.org/x", '<link href="https://b.net/y" rel="canonical">'),
        (2, "https://b.net/y", None),
        (3, "http://c.example.org/z#f", '<META http-equiv="refresh" content="0; url=/w?q=1">'),
        (4, "https://c.example.org/w?q=1", "<link rel=canonical href='//a.example.org/x'>"),
        (5, "https://d.org/fr/p", '<link rel="canonical" href="https://b.net/y">'),
        (6, None, '<link rel="canonical" href="https://b.net/y">'),
        (7, "nourl", "x"),
        (8, "HTTP://Q.Example.COM/de/?a", None),
        (9, "https://e.org/", None),
        (9, "https://e.org/", None),
        (10, "https://b.net", None),
        (11, "https://f.org/k", None),
    ]
    frame_ = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("https://f.org/k", "https://x.example.com/de/1"), (None, "https://b.net/y")], "from_url string, to_url string")
    got = rows(urls.verdicts(frame_, RULES, moved), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(
        [
            (1, "a.example.org", "/x", None, "block"),
            (2, "b.net", "/y", "net/", "block"),
            (3, "c.example.org", "/z", None, "block"),
            (4, "c.example.org", "/w", None, "block"),
            (5, "d.org", "/fr/p", "org/fr/", "allow"),
            (6, "", "", None, "allow"),
            (7, "", "", None, "allow"),
            (8, "q.example.com", "/de/", "example.com/de/", "block"),
            (9, "e.org", "/", None, "allow"),
            (9, "e.org", "/", None, "allow"),
            (10, "b.net", "", None, "allow"),
            (11, "f.org", "/k", None, "block"),
        ],
        key=repr,
    )
    assert urls.verdicts(frame_.limit(0), RULES).collect() == []
    con = duckdb.connect()  # the registered SQL follows the links of the pages as well
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [*pages, *LINKED])
    both = frame_.unionByName(spark.createDataFrame(LINKED, frame_.schema))
    got = rows(urls.verdicts(both, RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(con.execute(URL_SQL).fetchall(), key=repr)
    assert sum(r[3] is None and r[4] == "block" for r in got) >= 6


# 10 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeats_are_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = rows(suffixes.removal_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats(DOCUMENTS)


def test_repeats_of_repeated_rows(spark):
    same = " ".join(f"line{k} of one text" for k in range(60))
    given = [(1, same, "en")] * 40 + [(None, same, "en")] * 30 + [(k, f"{k} starts here {same[100:400]} ends {k}", "en") for k in range(2, 6)] + DOCUMENTS
    got = rows(suffixes.removal_report(frame(spark, given).repartition(3)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats(given)


def test_repeats_of_many_repeated_rows(spark):
    same = " ".join(f"word{k * k % 7919}" for k in range(600))
    given = frame(spark, [(None, same, "en")] * 5_000 + [(7, same, "en")] * 5_000 + [(8, "alone " * 3, "en")]).repartition(8)
    got = suffixes.removal_report(given).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(None, len(same), 1, 5_000), (7, len(same), 1, 5_000), (8, 0, 0, 1)}


def test_texts_without_repeats(docs, empty):
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCUMENTS)
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[1].text == "" and texts[9].text == "only four words here" and texts[6].text is None
    assert texts[4].text.startswith("alpha beta") and "number7" not in texts[4].text and texts[4].n_chars == len(texts[4].text)
    assert suffixes.removal_report(empty).collect() == [] and suffixes.without_repeats(empty).collect() == []


def test_samples_meet_in_equal_strings():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    data[3000:3400] = data[1000:1400]
    start, count, name = suffixes.samples(data, np.array([0, 2500, 4000]))
    at = {int(s) + k: (n, int(s)) for s, c, n in zip(start, count, name) for k in range(c)}
    assert sorted(at) == [p for p in range(3801) if p + 200 <= 2500 or p >= 2500]
    assert all(at[p][0] == at[p + 2000][0] for p in range(1000, 1201))

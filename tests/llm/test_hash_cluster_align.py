"""Exact duplicates, centroid clusters and token alignment against brute force on awkward rows."""

import bisect
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import DOCUMENTS, SCHEMA, frame, lower
from pyspark.sql import functions as F

from tidemark.llm import alignment, centroids, perfect
from tidemark.llm.queries import both_vocabularies


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 -----------------------------------------------------------------------------------------------

COPIES = [
    *DOCUMENTS,
    *[(100 + k, "Said Many Times" if k % 2 else "said many times", "en") for k in range(400)],
    (None, "only without ids", "en"),
    (None, "ONLY without ids", "de"),
    (None, "said many times", "de"),
    (600, None, None),
    (700, "ÄÖ kelvin K", None),
    (701, "äö kelvin k", None),
]


def equal_groups(given):
    members = defaultdict(list)
    for i, t, _ in given:
        members[hashlib.sha256(lower(t)).hexdigest()].append(i)
    out = []
    for name, ids in members.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = Counter()
        for i in ids:
            kept = i == keep and not stays[keep]
            stays[keep] += kept
            out.append((i, keep, len(ids), kept, name))
    return sorted(out, key=repr)


HISTORIES = {
    "none": "false",
    "all": "true",
    "null": "CAST(NULL AS BOOLEAN)",
    "some": "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 2 = 0",
}


@pytest.mark.parametrize("history", HISTORIES)
def test_exact_duplicates_are_brute_force(spark, history, monkeypatch):
    monkeypatch.setattr(perfect, "SLOTS", 5)  # many shards, and several parts of a shard
    docs = frame(spark, COPIES).repartition(5)
    got = rows(perfect.exact_duplicates(docs, F.expr(HISTORIES[history])), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == equal_groups(COPIES)


def test_one_row_of_each_text_stays_with_its_columns(spark, empty):
    extra = ["place", "digest", "keep_id", "keep_place", "rows", "known", "row", "historical", "shard", "part"]
    docs = frame(spark, COPIES)
    for name in extra:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    kept = perfect.deduplicated(docs, F.expr(HISTORIES["some"]))
    assert kept.columns == docs.columns
    got = rows(kept, "doc_id", *extra)
    assert got == sorted(((i, *(f"own {n}" for n in extra)) for i, _, _, k, _ in equal_groups(COPIES) if k), key=repr)
    assert rows(perfect.exact_duplicates(docs, F.expr(HISTORIES["all"])), "doc_id", "kept") == sorted(((i, k) for i, _, _, k, _ in equal_groups(COPIES)), key=repr)
    assert perfect.deduplicated(empty, F.expr(HISTORIES["some"])).collect() == perfect.exact_duplicates(empty, F.expr(HISTORIES["all"])).collect() == []


def test_index_holds_digests_and_winners(spark, monkeypatch):
    monkeypatch.setattr(perfect, "SLOTS", 50)
    folded = perfect.folded(perfect.digested(frame(spark, COPIES)))
    index = perfect.indexed(folded).collect()
    assert 1 <= len(index) <= len({h for *_, h in equal_groups(COPIES)}) // 50 + 1
    want = {h: (keep, n) for _, keep, n, _, h in equal_groups(COPIES)}
    seen = {}
    for shard in index:
        function = perfect.PerfectHash(shard.sizes, bytes(shard.bits))
        digests = [bytes(shard.digests[k : k + 32]) for k in range(0, len(shard.digests), 32)]
        keys = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
        assert function.slots(keys).tolist() == list(range(len(digests)))
        seen |= {d.hex(): (i, n) for d, i, n in zip(digests, shard.keep_id, shard.rows)}
    assert seen == want


def test_perfect_hash_of_many_keys():
    keys = np.random.default_rng(0).integers(0, 1 << 63, (50_000, 4), dtype=np.uint64)
    keys[1] = keys[0]
    keys[1, 3] += np.uint64(1)  # digests that differ in the last word only
    sizes, bits = perfect.PerfectHash.of(keys)
    slots = perfect.PerfectHash(sizes, bits).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert 8 * len(bits) < 5 * len(keys)
    assert perfect.PerfectHash(*perfect.PerfectHash.of(keys[:0])).slots(keys[:3]).tolist() == [-1] * 3


# 12 -----------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds, dim, scale=1024, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the centroids, with full distances."""
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    name = lambda i: "g" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]

    def place(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x)) for x in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [place(v)[0] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), x in zip(kept, at) if x == j]
            if own:
                c[j] = [sum(p) // len(own) for p in zip(*own)]
    last = [place(v) for _, v in kept]
    inertia = Counter()
    for j, d in last:
        inertia[j] += d
    hashed = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashed[j]) for (i, _), (j, d) in zip(kept, last)], key=repr), c


VECTORS = "vec_id long, embedding array<float>, label int, x string, norm int, dots int, cluster string, distance string"
CLUSTERS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def awkward_vectors(n, dim):
    rng = random.Random(4)
    given = [(k, [round(rng.gauss(k % 3, 0.4), 3) for _ in range(dim)]) for k in range(n)]
    given += [(5, given[5][1]), (n, [0.5] * dim), (n + 1, [0.5] * dim), (n + 2, [-0.0001] * dim)]
    given += [(n + 3, None), (n + 4, []), (n + 5, [1.0] * (dim - 1)), (n + 6, [None] + [1.0] * (dim - 1)), (n + 7, [float("nan")] + [1.0] * (dim - 1))]
    return [*given, (n + 8, [float("inf")] * dim), (None, [0.25] * dim), (None, [0.25] * dim)]


def vectors_frame(spark, given):
    return spark.createDataFrame([(i, v, 1, "a", 2, 3, "b", "c") for i, v in given], VECTORS)


@pytest.mark.parametrize("k,rounds,dim,n", [(8, 10, 64, 60), (4, 3, 5, 200), (3, 0, 2, 20), (30, 4, 3, 10)])
def test_clusters_are_full_distances(spark, k, rounds, dim, n):
    given = awkward_vectors(n, dim)
    want, c = lloyd(given, k, rounds, dim)
    got = rows(centroids.centroid_clusters(vectors_frame(spark, given).repartition(3), k, rounds, dim), *CLUSTERS)
    assert got == want
    state, now = centroids.clustered(vectors_frame(spark, given), k, rounds, dim)
    assert now.tolist() == c
    for r in state.collect():  # the kept dot products are the full ones
        x = np.frombuffer(bytes(r.x), "<i4").astype(np.int64)
        assert np.frombuffer(bytes(r.dots), "<i8").tolist() == (now @ x).tolist() and r.norm == int(x @ x)


def test_clusters_of_no_vectors_and_of_too_large_ones(spark):
    assert centroids.centroid_clusters(vectors_frame(spark, [])).collect() == []
    assert centroids.centroid_clusters(vectors_frame(spark, [(1, None), (2, [1.0])])).collect() == []
    same = [(k, [0.125] * 64) for k in range(20)]  # all ties: the smallest cluster holds all, the others stay empty
    assert {(r.cluster, r.distance) for r in centroids.centroid_clusters(vectors_frame(spark, same)).collect()} == {(0, 0)}
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(vectors_frame(spark, [(1, [1e30] * 64)])).collect()


# 13 -----------------------------------------------------------------------------------------------

TEXTS = [
    *DOCUMENTS,
    (30, " leading and  double   blanks ", "en"),
    (31, "tabs\tand\nlines\r\n\n  mixed", "en"),
    (32, "a ▁ mark and a▁nother", "en"),  # the second vocabulary gives a blank back: no tokens
    (33, "<s> </s> <unk> <0x41> <|endoftext|>", "en"),
    (34, "🙂🙃 emoji 👨‍👩‍👧 and é", "en"),
    (35, "\x00\x01 control", "en"),
    (36, "x" * 3000 + " " + "aAbB19" * 300, "en"),
    (37, "été 名前 " * 50, "fr"),
    (None, "the cat, the cat", "en"),
    (38, "the cat, the cat", "en"),
]


def byte_of():
    """The printable stand-ins of a byte-level vocabulary."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + n)] = b
            n += 1
    return out


def by_hand(given):
    """Groups and links of each document with plain loops, whole texts through both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        entry = {k: t for t, k in json.load(f)["model"]["vocab"].items()}
    table = byte_of()
    documents = []
    for i, t, _ in given:
        a = full.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        bytes_a = [bytes(table[c] for c in entry[k]) for k in a]
        pieces = [model.id_to_piece(k) for k in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, pieces)]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == f" {t}".encode():
            documents.append((i, [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, low, x, y = [], 0, 0, 0
        overlaps = []
        starts = [[e - len(s) for e, s in zip(ends[v], side)] for v, side in enumerate((bytes_a, bytes_b))]
        for p in range(len(a)):
            q = bisect.bisect_right(ends[1], starts[0][p])
            while q < len(b) and starts[1][q] < ends[0][p]:
                overlaps.append([p, q, min(ends[0][p], ends[1][q]) - max(starts[0][p], starts[1][q])])
                q += 1
        for high in common:
            own = ([], [])
            while x < len(a) and ends[0][x] <= high:
                own[0].append(a[x])
                x += 1
            while y < len(b) and ends[1][y] <= high:
                own[1].append(b[y])
                y += 1
            groups.append(own)
            low = high
        documents.append((i, groups, overlaps))
    held = Counter()
    for _, groups, _ in documents:
        held.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    most = Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for i, groups, overlaps in documents:
        pairs = Counter()
        for g in groups:
            for p, n in Counter(g[0]).items():
                for q, m in Counter(g[1]).items():
                    pairs[p, q] += n * m
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append(
            (
                i,
                sum(len(g[0]) for g in groups),
                sum(len(g[1]) for g in groups),
                len(groups),
                sum(pairs.values()),
                sum(n for p, n in pairs.items() if held[p] == most[p[0]]),
                sum(n * held[p] for p, n in pairs.items()),
                hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
                len(overlaps),
            )
        )
    return sorted(out, key=repr), documents


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


@pytest.fixture(scope="module")
def expected():
    return by_hand(TEXTS)


@pytest.mark.parametrize("head", [alignment.HEAD, 300, 0])
def test_alignment_is_brute_force(spark, expected, head):
    docs = frame(spark, TEXTS).repartition(4).withColumn("a", F.lit(1)).withColumn("place", F.lit(2)).withColumn("n", F.lit("z"))
    assert rows(alignment.alignment(docs, both_vocabularies, head), *ALIGNED) == expected[0]


def test_alignment_does_not_depend_on_the_parts(spark, expected, monkeypatch):
    monkeypatch.setattr(alignment, "ENTRIES", 40)
    monkeypatch.setattr(alignment, "HELD", 50)
    a, b = both_vocabularies()
    texts = [t for _, t, _ in TEXTS]
    for size in (1, 64, 1 << 30):
        found = alignment.Aligned(texts, a, b, size)
        got = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.spelled()]
        assert sorted(zip([i for i, _, _ in TEXTS], got), key=repr) == sorted(((r[0], r[7]) for r in expected[0]), key=repr)


def test_alignment_of_nothing(spark, empty):
    assert alignment.alignment(empty, both_vocabularies).collect() == []
    got = alignment.alignment(frame(spark, [(1, None, None), (2, "", None)]), both_vocabularies).collect()
    assert sorted(tuple(r) for r in got) == [(k, 0, 0, 0, 0, 0, 0, "", 0) for k in (1, 2)]


def test_overlaps_are_shared_bytes(spark, expected):
    got = sorted((r.doc_id, sorted(r.overlaps)) for r in alignment.token_links(frame(spark, TEXTS), both_vocabularies).collect() if r.doc_id is not None)
    assert got == sorted((i, sorted(o)) for i, _, o in expected[1] if i is not None)


def test_product_is_the_dense_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, m, p = rng.integers(1, 12, 3)
        a, b = rng.integers(0, 3, (n, m)), rng.integers(0, 3, (m, p))
        sparse = [alignment.Csr.of(np.repeat(*np.nonzero(x)[:1], x[x > 0]), np.repeat(np.nonzero(x)[1], x[x > 0]), *x.shape) for x in (a, b)]
        for entries in (1, 7, 1000):
            out = np.zeros((n, p), np.int64)
            for row, column, value in alignment.product(*sparse, entries):
                out[row, column] += value
            assert (out == a @ b).all()

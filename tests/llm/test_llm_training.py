"""Packing, clustering and resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import clusters, packing, queries, resampling, statements

DIR = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "one", "  a  b", "a \tb", "a\n b", " x", "y ", "a\x1c b", "a  b", "don't I'm we'll", "<|endoftext|> x",
    " " * 3000 + "x", "漢字 " * 700, "word " * 3000, "\U0001f600\u0000\n\n" * 40,
]


# --- packing ---


def plain_assign(lengths, capacity):
    """The same rules with lists and no arrays."""
    pieces, queue, full = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            queue.append((n % capacity, d, n // capacity * capacity))
    left = sum(n for n, *_ in queue)
    sizes = [capacity] * (left // capacity) + [1 << k for k in range(20, -1, -1) if left % capacity >> k & 1]
    room, costs = list(sizes), [0] * len(sizes)
    while queue:
        n, d, start = max(queue, key=lambda p: (p[0], -p[1], -p[2]))
        queue.remove((n, d, start))
        fits = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
        s = min(fits, key=lambda s: (costs[s], s))
        taken = min(n, room[s])
        pieces.append((d, start, taken, full + s, sizes[s] - room[s]))
        room[s] -= taken
        costs[s] += packing.cost(taken)
        if taken < n:
            queue.append((n - taken, d, start + taken))
    return sorted(pieces)


@pytest.mark.parametrize("seed", range(6))
def test_assignment_follows_the_rules(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 64, 64, rng.randint(1, 300)]) for _ in range(rng.choice([0, 1, 5, 80]))]
    assert sorted(map(tuple, packing.assign(np.array(lengths, np.int64), 64).tolist())) == plain_assign(lengths, 64)


def check_pieces(rows, expected):
    """``expected``: the ids of each document, its end id included, by key."""
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert own.keys() == expected.keys()
    for key, ids in expected.items():
        at = 0
        for r in sorted(own[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and ("ids" not in r or r.ids == ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_pieces_hold_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(TOKENS)
    tokenizer.encode_special_tokens = True
    rows = [(i, t, "keep", "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, other string").repartition(3)
    packed = packing.pack(docs, TOKENS)
    assert packed.columns == ["doc_id", "text", "other", *packing.PIECE, "ids"]
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    got = packed.collect()
    check_pieces(got, expected)
    built = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in built) == sum(map(len, expected.values()))
    assert all(sum(r.lengths) == len(r.ids) and r.cost == sum(map(packing.cost, r.lengths)) for r in built)


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 4 + [(1, "x " * 900), (1, None)], "doc_id long, text string").coalesce(1)
    packed = packing.pack(docs, TOKENS, with_ids=False)
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.doc_id == 1 and r.start == 0 for r in rows) == 2
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 4
    assert packing.pack(docs.limit(0), TOKENS).count() == 0
    assert sorted(rows, key=str) == sorted(packed.collect(), key=str)


def test_windows_close_inside_of_batches(spark):
    # more than a window, in one partition; ids go with their documents
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('a ', cast(id % 5 as int)) AS text").coalesce(1)
    rows = packing.pack(docs, TOKENS).collect()
    tokenizer = Tokenizer.from_file(TOKENS)
    five = [[*tokenizer.encode("a " * k).ids, 0] for k in range(5)]
    check_pieces(rows, {i: five[i % 5] for i in range(9000)})


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5, 0.8, 4000).astype(int) + 1, 1023)
    pieces = packing.assign(lengths)
    costs, tokens = np.zeros(pieces[:, 3].max() + 1), np.zeros(pieces[:, 3].max() + 1)
    np.add.at(costs, pieces[:, 3], packing.cost(pieces[:, 2]))
    np.add.at(tokens, pieces[:, 3], pieces[:, 2])
    full = costs[tokens == 1024]
    assert len(full) > 100 and full.std() / full.mean() < 0.05
    # few documents are cut
    assert len(pieces) < 1.2 * len(lengths)


def test_registered_packing(spark):
    tokenizer = Tokenizer.from_file(TOKENS)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    check_pieces(
        queries.op11_packing(spark, DIR).collect(),
        {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs},
    )


# --- clustering ---


def plain_clusters(rows, k, rounds, seed, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(2**27), min(2**27, math.floor(1024 * x))) for x in v]))
    key = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centers = [x for _, x in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        for j, g in groups.items():
            centers[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for i, d, j in found), key=str)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, 0.3) for x in c]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, seed):
    rows = vectors(seed, 300, 6)
    rows += [(1000, None), (1001, [0.1] * 5), (1002, [0.1] * 5 + [None]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6)]
    rows += [(1005, [1e30] * 6), (1006, rows[3][1]), (7, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 6), (1007, [0.25] * 6), (1008, [0.25] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = clusters.facts(clusters.fit(df, 5, 6, seed, 6)).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 5, 6, seed, 6)


def test_few_or_no_vectors(spark):
    rows = vectors(1, 3, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, clusters.facts(clusters.fit(df, 8, 2, 3, 4)).collect()), key=str) == plain_clusters(rows, 8, 2, 3, 4)
    assert clusters.facts(clusters.fit(df.limit(0), 8, 2, 3, 4)).collect() == []


def test_falls_hold_for_every_point_of_the_sphere_and_are_less_than_drift():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(60):
        old = rng.integers(-1000, 1000, (4, 3))
        new = old + rng.integers(-200, 200, (4, 3))
        radius = rng.uniform(1, 600, 4)
        fall = clusters.planar_fall(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(4):
            way = rng.normal(size=(400, 3))
            way *= (radius[i] * rng.uniform(0.5, 1, (400, 1))) / np.sqrt((way**2).sum(1, keepdims=True))
            x = old[i] + way
            others = [j for j in range(4) if j != i]
            nearer = [np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1)) for j in others]
            assert np.max(nearer) <= fall[i] + 1e-6
            tighter += fall[i] < 0.95 * drift[others].max()
    assert tighter > 60


def test_unambiguous_vectors_are_not_scanned():
    rng = np.random.default_rng(2)
    centers = rng.integers(-50_000, 50_000, (8, 16))
    x = np.repeat(centers, 100, 0) + rng.integers(-300, 300, (800, 16))
    cluster, upper, lower = np.full(800, -1, np.int32), np.zeros(800), np.zeros(800)
    start = clusters.moved(centers, centers, np.full(8, -1.0))
    assert clusters.reassign(x, cluster, upper, lower, start) == 800
    radius = np.array([upper[cluster == c].max() for c in range(8)])
    again = clusters.moved(centers, centers + rng.integers(-20, 20, (8, 16)), radius)
    before = cluster.copy()
    assert clusters.reassign(x, cluster, upper, lower, again) == 0 and (before == cluster).all()


# --- resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_resample(docs, target, n, buckets, percent, min_words, seed):
    def found(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    total_s, total_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, x in docs:
        f = found(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


DOCS = [
    (0, None), (1, ""), (2, "... ---"), (3, "One two THREE two one"), (4, "ünï cödé Été été ÉTÉ a b"), (5, "x" * 3000 + " y"), (None, "one two three four five six"),
    (None, "one two three four five six"), (6, "a\nb\na b"), (6, "other text with one id"), (7, "\u0000\u0001 a\u0080b 0123 4.5"), (8, "lorem ipsum " * 400),
] + [(100 + i, " ".join(f"w{(i * j) % 37} Q{j % (i + 2)}" for j in range(i))) for i in range(60)]
TARGET = ["w1 w2 w3 one two", None, "", "lorem w1, W1; q3"]


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (2, 512), (3, 64)])
def test_resampling_equals_plain_version(spark, n, buckets):
    docs = spark.createDataFrame([(*d, 5) for d in DOCS], "doc_id long, text string, rank int").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.facts(resampling.resample(docs, target, n, buckets, 30, 4)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(DOCS, TARGET, n, buckets, 30, 4, 2024)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    got = resampling.facts(resampling.resample(docs, docs.limit(0), percent=100, min_words=0)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(DOCS, [], 1, 10_000, 100, 0, 2024)
    assert sorted(r[4] for r in got) == list(range(1, len(DOCS) + 1))


def test_joined_checksums():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.choice([0, 1, 5, 300])), rng.randbytes(rng.choice([0, 1, 2, 70_000]))) for _ in range(50)]
    crcs = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    joined = resampling.joined_crc(crcs(0), crcs(1), np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_target_resampling"])
def test_statements(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, DIR)
    result = db.execute(statements.statements()[name])
    assert [d[0] for d in result.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, result.fetchall()))


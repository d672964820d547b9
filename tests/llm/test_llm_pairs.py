"""Near duplicates, components, fingerprints, suffix array, mixing and scores against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprint, lattice, minhash, mixing, suffixes
from lectern.llm.components import connected

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(seed, n=120, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            own = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 1, 2, 6, 12])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))))
    return out


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n):
    sets = {i: shingle_set(t, n) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "few"), [(2, 16), (5, 16), (2, 1)])
def test_near_duplicates(spark, monkeypatch, n, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    texts = random_texts(n)
    odd = [None, "", "  ", "Solo", "solo", "a b", "A\tB", "x y z", "long " * 20_000, "long " * 20_001]
    # a group of edited copies of one text that are less like each other than like it
    rng, base = random.Random(9), [f"b{k}" for k in range(150)]
    for _ in range(40):
        own = list(base)
        for k in rng.sample(range(150), 5):
            own[k] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    rows = list(enumerate([*odd, *texts]))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    got = minhash.components(df, shingle=n).collect()
    expected = brute_components(rows, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    kept = minhash.near_duplicates_removed(df, shingle=n)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}


@pytest.mark.parametrize("at_once", [2000, 8])
def test_near_duplicates_in_a_bucket_of_alike_texts(spark, monkeypatch, at_once):
    """Texts from one pattern share keys in crowds; only some are alike enough."""
    monkeypatch.setattr(minhash, "ROWS_AT_ONCE", at_once)
    rng, base = random.Random(5), [f"b{k}" for k in range(100)]
    texts = []
    for _ in range(70):
        own = list(base)
        for k in rng.sample(range(100), 6):
            own[k] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(own))
        if rng.random() < 0.3:
            own[rng.randrange(100)] = "other"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = minhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)
    pairs = [(len(a & b), len(a | b)) for a, b in itertools.combinations([shingle_set(t, 2) for t in texts], 2)]
    assert sum(65 * all_ <= 100 * both < 80 * all_ for both, all_ in pairs) > 1000


@pytest.mark.parametrize("places", [1, 3])
def test_links_of_cells(places):
    """Every two places meet once, and links only join what is apart."""
    rng = random.Random(places)
    texts = random_texts(31, 90)
    sets = [np.array(sorted({hash(s) % 2**64 for s in shingle_set(t, 2)}), np.uint64) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = minhash.packed_bits(minhash.signatures(np.concatenate(sets), begins)).tolist()
    at = [rng.randrange(places) for _ in sets]
    component = {i: i for i in range(len(sets))}
    for p in range(places):
        for q in range(p, places):
            use = [i for i in range(len(sets)) if at[i] in (p, q)]
            if not use:
                continue
            cell = pa.table(
                {
                    "p": [p] * len(use), "q": [q] * len(use), "place": [at[i] for i in use], "rep": use, "component": use,
                    "n": [len(sets[i]) for i in use], "bits": [bits[i] for i in use],
                    "members": [sets[i].view(np.int64).tolist() for i in use],
                }
            )
            links = minhash.cell_links(cell, 80).to_pylist()
            assert len(links) < len(use) and (p == q or all(at[r["a"]] != at[r["b"]] for r in links))
            for r in links:
                x, y = component[r["a"]], component[r["b"]]
                component = {i: min(x, y) if c in (x, y) else c for i, c in component.items()}
    assert component == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2).items()}


def test_near_duplicates_edge_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(tuple(r) for r in minhash.components(spark.createDataFrame(rows, schema)).collect() if r.doc_id is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_estimate_is_close(spark):
    a = {f"a{k} b" for k in range(400)}
    rows = [(1, " ".join(sorted(a))), (2, " ".join(sorted(a)[:300]))]
    signed = {r.doc_id: r.bits for r in minhash.signed(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    df = spark.createDataFrame([(signed[1], signed[2])], "x array<long>, y array<long>")
    value = df.select(minhash.estimate(df.x, df.y)).first()[0]
    sets = [shingle_set(t, 2) for _, t in rows]
    assert abs(value - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 100), (7, 7), (None, 3), (200, 300), (300, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100, 200: 200, 300: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, monkeypatch):
    texts = [*random_texts(3, 60), None, "", "one", "one", "é " * 40, "x " * 30_000]
    ids = random.Random(4).sample(range(10_000), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 3000)
    got = {r.doc_id: r for r in fingerprint.compare_next(df.repartition(4)).collect()}
    assert len(got) == len(rows)
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df.drop("fingerprint")).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == plain[i]
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = shingle_set(t, 5), shingle_set(other, 5)
            true = len(a & b) / len(a | b) if a and b else float(not a and not b)
            # lower-casing aside, 256 bins
            assert abs(value - true) < 0.2, (t[:50], other[:50])
    assert fingerprint.compare_next(df.limit(0)).count() == 0
    single = fingerprint.compare_next(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert single.near_next == 1.0


def test_densification_fills_all():
    least = np.full((3, 16), fingerprint.EMPTY)
    least[1, 5] = 7
    least[2, [1, 9]] = [3, 4]
    out = fingerprint.densified(least)
    assert (out[0] == fingerprint.EMPTY).all() and (out[1] == 7).all() and set(out[2]) == {3, 4} and out[2, 9] == 4


def brute_repeats(rows, length):
    starts = Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        starts.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length", [25, 60])
def test_suffix_array_dedup(spark, length):
    rng = random.Random(length)
    letters = "abcdeé "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(50)]
    passage = "".join(rng.choice(letters) for _ in range(90))
    for i in range(40):
        own = rng.choice(texts[:50])
        a, b = sorted((rng.randrange(len(own) + 1), rng.randrange(len(own) + 1)))
        texts.append(rng.choice([own[a:b], own, passage, own[:a] + passage + own[b:], own + own, "z" * rng.randint(0, 80), own[:a] + "Q" + own[a:]]))
    texts += [None, "", "y" * 300, "abab" * 60, "abab" * 61 + "c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal_facts(df, length).collect()}
    expected = brute_repeats(rows, length)
    assert {i for i in expected if got.get(i) != expected[i]} == set()
    cut = {r.doc_id: r.text for r in suffixes.repeats_removed(df, length).collect()}
    assert len(cut) == len(rows)
    assert all(len((cut[i] or "").encode()) <= expected[i][0] - expected[i][1] for i in cut)
    assert all(cut[i] == t for i, t in rows if expected[i][1] == 0)


def test_suffix_array_edge_tables(spark):
    schema = "doc_id long, text string"
    assert suffixes.removal_facts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "q" * 500), (1, "q" * 500), (None, "short"), (2, "x" * 399)]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.removal_facts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 500, 500), (None, 5, 0), (2, 399, 0)}


def test_texts_are_told_apart_by_their_bytes_and_not_by_their_ids(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, copied = prose(90), prose(80)
    texts = [prose(20) + passage + prose(20), prose(50) + passage, passage + prose(30), prose(60), copied, copied, "", None, prose(70) + passage[:399], passage[7:]]
    ids = ["a", "a", None, None, None, "b", "b", None, "c", "a"]
    expected = brute_repeats(list(enumerate(texts)), 400)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").repartition(3)
    got = sorted(map(str, map(tuple, suffixes.removal_facts(df).collect())))
    assert got == sorted(str((i, *expected[k])) for k, i in enumerate(ids))
    assert sum(e[1] for e in expected.values()) > 2000
    cut = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in suffixes.repeats_removed(df).collect())
    assert cut == sorted((str(i), expected[k][3]) for k, i in enumerate(ids))


def test_suffix_ranks_are_the_suffix_order(spark):
    rng = random.Random(1)
    strings = {i: [rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for i in range(12)}
    df = spark.createDataFrame(list(strings.items()), "doc_id long, s array<long>")
    ranks = {r.doc_id: r.r for r in suffixes.suffix_ranks(df, 4).collect()}
    places = [(i, k) for i, s in strings.items() for k in range(len(s))]
    for i, k in places:
        for j, m in places:
            a, b = strings[i][k:], strings[j][m:]
            short = min(len(a), len(b))
            if a[:short] != b[:short]:
                assert (a < b) == (ranks[i][k] < ranks[j][m])


def test_mixing(spark):
    rng = random.Random(5)
    own = {"a": [f"a{k}" for k in range(50)], "b": [f"b{k}" for k in range(50)], "c": [f"c{k}" for k in range(50)]}
    rows = [(i, " ".join(rng.choice(own[d]) for _ in range(rng.randint(5, 60))), d) for i, d in enumerate("a" * 200 + "b" * 60 + "c" * 30)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "a"), (0, rows[0][1], "a")], "doc_id long, text string, domain string")
    weights = {"a": 0.4, "b": 0.3, "c": 0.3}
    got = mixing.mixed(docs, docs, weights).collect()
    assert len(got) == docs.count() and min(r.rate for r in got) >= 0
    total = sum(r.n_tokens for r in got)
    for k, d in enumerate("abc"):
        share = sum(r.rate * r.n_tokens * r.posterior[k] for r in got) / total
        assert abs(share - weights[d]) < 1e-3
    assert {r.doc_id: r.domain for r in got}[250] == "b" and all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert {r.n_tokens for r in got if r.doc_id >= 900} == {0}
    raised = mixing.mixed(docs, docs, weights, floor=1.0)
    assert raised.where("copies < 1").count() == 0
    sums = np.sum([np.array(r.posterior) * r.rate * r.n_tokens for r in raised.collect()], axis=0)
    assert np.allclose(sums / sums.sum(), [0.4, 0.3, 0.3], atol=5e-3)
    again = mixing.repeated(docs, raised.select("doc_id", "copies"))
    assert again.columns == docs.columns and again.count() >= docs.count()
    unlabelled = mixing.mixed(docs, docs.limit(0), weights).collect()
    assert {r.rate for r in unlabelled} == {1.0}
    assert mixing.mixed(docs.limit(0), docs, weights).count() == 0


def test_mixing_equals_direct_solution(spark):
    shares = np.random.default_rng(2).dirichlet([0.3, 0.3, 0.3], 300)
    tokens = np.random.default_rng(3).integers(1, 500, 300)
    table = spark.createDataFrame([(int(t), [float(x) for x in s]) for t, s in zip(tokens, shares, strict=True)], "n_tokens long, posterior array<double>")
    targets = np.array([0.8, 0.15, 0.05])
    state = mixing.fit(table, targets, rounds=60, tolerance=1e-9)
    rates = np.ones(300)
    weight = (shares * tokens[:, None]).sum(axis=0)
    width = tokens.sum() / np.linalg.eigvalsh((shares * tokens[:, None]).T @ shares).max()
    for _ in range(20_000):
        rates = np.maximum(0, rates - width * shares @ ((rates * tokens) @ shares / tokens.sum() - targets))
    own = state.rates(shares)
    assert weight.shape == (3,) and (own >= 0).all()
    gap = [np.linalg.norm((r * tokens) @ shares / tokens.sum() - targets) for r in (own, rates)]
    assert gap[0] <= gap[1] + 5e-3


def plain_marginal(pieces, word):
    logs = dict(zip(pieces.surfaces, pieces.logs, strict=True))
    own = b" " + word
    ways = [1.0] + [0.0] * len(own)
    for stop in range(1, len(own) + 1):
        ways[stop] = sum(ways[a] * math.exp(logs[own[a:stop]]) for a in range(stop) if own[a:stop] in logs)
    return math.log(ways[-1])


def test_lattice_marginals():
    pieces = lattice.vocabulary(MODEL)
    assert abs(np.exp(pieces.logs).sum() + math.exp(pieces.end) - 1) < 1e-9
    words = ["the", "understanding", "é", "日本", "x", "\x01", "aaaaaaaaaaaaaaaaaaaaaaaa", "the"]
    got = lattice.marginals(pieces, [w.encode() for w in words])
    assert np.allclose(got, [plain_marginal(pieces, w.encode()) for w in words])


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MAX_FREQUENT", 20)
    monkeypatch.setattr(lattice.frequent, "__defaults__", (20,))
    texts = [*random_texts(8, 40, 60), None, "", "The the THE", "unseenword here", "é " * 3000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lattice.scores(df, MODEL).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    counts = Counter(w for i, own in split if not held[i] for w in [*own, None])
    total, distinct = sum(counts.values()), len(counts)
    base = {}
    for i, own in split:
        tokens = [*own, None]
        base[i] = (
            held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total,
            sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens),
        )
    for r in got:
        e = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert abs(r.base_score - e[4]) < 1e-6 * max(1, abs(e[4]))
        assert math.isfinite(r.score) and r.score < 0
    assert lattice.scores(df.limit(0), MODEL).count() == 0


def test_scores_follow_the_adapted_pieces(spark):
    texts = random_texts(11, 30, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.scores(df, MODEL).collect()}
    pieces = lattice.vocabulary(MODEL)
    plain = [w.encode() for w in texts[0].split()]
    before = (lattice.marginals(pieces, plain).sum() + pieces.end) / math.log(10)
    assert got[0].score > before  # learning from the training texts helps
    weights = np.ones(len(plain))
    total = np.zeros(len(pieces.logs))
    for which, matrix in lattice.by_length(plain):
        own = lattice.Lattice(pieces, matrix)
        total += own.expected(own.forward(), weights[which])
    spelled = np.array([len(s) for s in pieces.surfaces])
    assert abs((total * spelled).sum() - sum(len(w) + 1 for w in plain)) < 1e-6


def test_word_hash_matches_python():
    from lectern.llm.words import word_slices

    texts = ["A b\tC", None, "", "  x ", "a b c", "é É"]
    words = [w for _, _, part in word_slices(pa.array(texts, pa.string())) for w in part.hashes.tolist()]
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(words) == len(flat)
    assert len({(w, h) for w, h in zip(flat, words, strict=True)}) == len(set(flat)) == len(set(words))


def test_short_common_passages_are_not_sorted(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shorts, long = [prose(224) for _ in range(12)], prose(450)
    texts = [prose(n) + short + prose(900 - n) for short in shorts for n in (300, 500)]
    first = len(texts)
    texts += [prose(300) + long + prose(600), prose(400) + long + prose(500)]
    docs = spark.createDataFrame([(str(i), t.encode()) for i, t in enumerate(texts)], "doc_id string, data binary")
    sketch = suffixes.sketches(docs, suffixes.Sizes(400)).cache()
    classes = sketch.groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    spans = {r.doc_id: r.spans for r in suffixes.regions(sketch, classes, 400).collect()}
    assert set(spans) == {str(first), str(first + 1)}
    for i in (first, first + 1):
        at = texts[i].index(long)
        merged = suffixes.merged(np.array([tuple(s) for s in spans[str(i)]]))
        assert any(a <= at and at + 450 <= b for a, b in merged.tolist())


def test_sorted_ranges_build_rows_once_and_spread_equal_keys(spark, tmp_path):
    def rows(frame, finish, schema):
        def run(batches):
            for batch in batches:
                for doc in batch.column("doc_id").to_pylist():
                    with open(tmp_path / f"built-{doc}", "a") as f:
                        f.write("x")
                    i = np.arange(200)
                    own = [np.full(200, doc), i, np.zeros(200, np.int32), np.ones(200, np.int64), np.where(i < 150, 7, i - 100 - doc), i % 3]
                    yield finish(pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=["doc_id", "i", "cls", "base", "c0", "c1"]))

        return frame.mapInArrow(run, schema or "doc_id long, i long, cls int, base long, c0 long, c1 long, part int")

    frame = spark.range(4000).select(F.col("id").alias("doc_id")).repartition(3)
    dealt = suffixes._dealt(frame, rows, ["c0", "c1"], 0, 8).withColumn("p", F.spark_partition_id())
    parts = dealt.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct("c0", "c1")).alias("a"), F.max(F.struct("c0", "c1")).alias("b")).orderBy("p").collect()
    assert sum(r.n for r in parts) == 800_000 and max(r.n for r in parts) < 200_000
    assert all(tuple(x.b) <= tuple(y.a) for x, y in zip(parts[:-1], parts[1:], strict=True))
    built = sum(len(f.read_text()) for f in tmp_path.iterdir())
    assert 4000 <= built < 6000


def _scratch_left(spark, frames):
    from lectern import session

    mark = session.scratch_mark(spark)
    for frame in frames():
        frame.count()
    return len(session._handed_out[spark.sparkContext.applicationId][mark:])


def test_stages_leave_only_their_last_step_on_disk(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = prose(80)
    texts = [prose(20) + " " + passage + " " + prose(20) for _ in range(6)] + [prose(40)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _scratch_left(spark, lambda: [suffixes.repeats_removed(docs, 101, min_words=51)]) == 1
    assert _scratch_left(spark, lambda: [suffixes.removal_facts(docs)]) == 1
    assert _scratch_left(spark, lambda: [minhash.near_duplicates_removed(docs)]) == 1


def test_a_common_passage_sends_two_rows_to_the_other_tasks(spark):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, copied = prose(700), prose(700)
    texts = [prose(500) + passage + prose(500) for _ in range(40)] + [copied] * 30
    docs = spark.createDataFrame([(str(i), t.encode()) for i, t in enumerate(texts)], "doc_id string, data binary").coalesce(1)
    sketch = suffixes.sketches(docs, suffixes.Sizes(400)).cache()
    sent = sketch.where("bucket is not null").select("bucket", F.explode("a").alias("a")).groupBy("bucket", "a").count()
    assert sent.agg(F.max("count")).first()[0] == 2
    found = {r.doc_id for r in sketch.where("size(found) > 0").collect()}
    assert found == {str(i) for i in range(40)}
    classes = sketch.where("bucket is null").groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    assert {r.doc_id for r in suffixes.regions(sketch, classes, 400).collect()} == found


def test_places_that_meet_only_in_other_tasks_are_found(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = prose(460)
    texts = [prose(rng.randint(300, 900)) + (passage if i % 3 == 0 else "") + prose(rng.randint(300, 900)) for i in range(12)]
    expected = brute_repeats(list(enumerate(texts)), 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal_facts(docs).collect()}
    assert got == expected and sum(e[1] > 0 for e in expected.values()) == 4

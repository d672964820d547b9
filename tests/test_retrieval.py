import math
import random
from collections import Counter

import numpy as np
import pytest

from lectern.operators.contain import containing
from lectern.operators import dense, fusion, ivf, lsa, metrics, quantized, ranking, sparse, tfidf
from lectern.operators.prepare import hard_negatives
from lectern.plans import retrieval
from lectern.sources import index as stored

WORDS = ["the", "of", "가나", "다라", "😀", "cat", "dog", "owl", "sun", "sky", "", "rare"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    docs = {i: " ".join(rng.choices(WORDS, weights=[30, 20, 5, 5, 2, 4, 4, 3, 3, 2, 1, 1], k=rng.randint(1, 40))) for i in range(60)}
    docs[60] = "the"
    return {i: t for i, t in docs.items() if t not in [docs[j] for j in range(i)]}


@pytest.fixture(scope="module")
def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").persist()


QUESTIONS = [(1, "the cat cat 가나"), (2, "unknown words only"), (3, "rare of the"), (4, "😀 sky  sun")]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid long, question string")


def bm25_scores(texts, question):
    docs = {i: t.split(" ") for i, t in texts.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        if any(tf[w] for w in question.split(" ")):
            out[i] = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in question.split(" "))
    return out


def best(scores, k, largest=True):
    order = sorted(scores, key=lambda i: ((-1 if largest else 1) * round(scores[i], 6), i))[:k]
    return [(r, i, round(scores[i], 6)) for r, i in enumerate(order, 1)]


def hits_of(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r["rank"], r.doc_id, round(r.score, 6)))
    return out


@pytest.mark.parametrize("terms_per_pass", [1_000_000, 5])
def test_bm25(spark, texts, corpus, questions, terms_per_pass, monkeypatch):
    monkeypatch.setattr(sparse, "SCORES_AT_ONCE", 40)
    got = hits_of(sparse.bm25_topk(questions, sparse.bm25_index(corpus), 7, terms_per_pass=terms_per_pass))
    want = {q: best(bm25_scores(texts, t), 7) for q, t in QUESTIONS}
    assert 2 not in got and got == {q: h for q, h in want.items() if h}


def test_top_k_grows_by_one(corpus, questions):
    index = sparse.bm25_index(corpus)
    small, large = hits_of(sparse.bm25_topk(questions, index, 4)), hits_of(sparse.bm25_topk(questions, index, 5))
    assert small == {q: h[:4] for q, h in large.items()}


def test_single_question_matches_bulk(spark, texts, corpus):
    index = sparse.bm25_index(corpus)
    assert hits_of(sparse.bm25_search(spark, QUESTIONS[0][1], index, 5))[0] == best(bm25_scores(texts, QUESTIONS[0][1]), 5)


def test_stored_index(spark, texts, corpus, questions, tmp_path):
    index = stored.bm25_store(spark, str(tmp_path), corpus, buckets=4)
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    again = stored.bm25_store(spark, str(tmp_path), corpus, buckets=4)
    assert stamps == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert hits_of(sparse.bm25_topk(questions, again, 7)) == hits_of(sparse.bm25_topk(questions, index, 7))
    for _, question in QUESTIONS:
        got = hits_of(stored.bm25_search_stored(spark, question, index, 5)).get(0, [])
        assert got == best(bm25_scores(texts, question), 5)


def test_interrupted_build_is_rebuilt(spark, corpus, tmp_path):
    path = stored.index_path(str(tmp_path), "bm25", corpus="corpus", buckets=4)
    spark.range(1).write.parquet(f"{path}/terms")
    assert stored.bm25_store(spark, str(tmp_path), corpus, buckets=4).terms.columns == ["term", "df", "idf"]


def grams(text):
    t = text.lower().split(" ")
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


def tfidf_vectors(texts, max_features):
    total = Counter(g for t in texts.values() for g in grams(t))
    df = Counter(g for t in texts.values() for g in set(grams(t)))
    vocab = sorted(total, key=lambda g: (-total[g], g))[:max_features]
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in vocab}

    def vector(text):
        w = {g: c * idf[g] for g, c in Counter(grams(text)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    return idf, vector


@pytest.mark.parametrize("terms_per_pass", [1_000_000, 5])
def test_tfidf(spark, texts, corpus, questions, terms_per_pass):
    model = tfidf.tfidf_fit(corpus, 30)
    idf, vector = tfidf_vectors(texts, 30)
    assert {t: round(w, 9) for t, w in zip(model.terms, model.idf)} == {t: round(w, 9) for t, w in idf.items()}
    got = hits_of(tfidf.tfidf_topk(questions, corpus, model, 6, terms_per_pass=terms_per_pass))
    docs = {i: vector(t) for i, t in texts.items()}
    for q, t in QUESTIONS:
        v = vector(t)
        scores = {i: sum(w * d[g] for g, w in v.items() if g in d) for i, d in docs.items() if set(v) & set(d)}
        assert got.get(q, []) == best(scores, 6)
    assert [r.qid for r in tfidf.oov_questions(questions, model).collect()] == [2]


def test_lsa_matches_a_plain_svd(spark, texts, corpus, questions):
    model = tfidf.tfidf_fit(corpus, 40)
    _, vector = tfidf_vectors(texts, 40)
    rows = np.array([[vector(t).get(g, 0.0) for g in model.terms] for t in texts.values()])
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    fitted = lsa.lsa_fit(corpus, model, 5, tolerance=1e-12)
    assert np.allclose(fitted.singular_values, s[:5])
    project = vt[:5].T
    got = hits_of(lsa.lsa_topk(questions, corpus, fitted, 5))
    assert 2 not in got  # it has no vocabulary term
    for q, t in QUESTIONS:
        if q != 2:
            v = np.array([vector(t).get(g, 0.0) for g in model.terms]) @ project
            scores = dict(zip(texts, (rows @ project @ v).tolist()))
            assert [round(x[2], 5) for x in got[q]] == [round(x[2], 5) for x in best(scores, 5)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    p = np.round(rng.normal(size=(120, 8)), 2).astype(np.float32)
    p[7] = p[9]  # a tie
    p[11] = 0.0  # a zero vector
    return p


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "doc_id long, embedding array<float>, label int").persist()


def asked(vectors):
    return vectors.where("doc_id < 25").withColumnRenamed("doc_id", "qid")


def exact(points, k, metric):
    p = points.astype(float)
    out = {}
    for q in range(25):
        s = p @ p[q] if metric == "inner_product" else ((p - p[q]) ** 2).sum(axis=1)
        out[q] = best(dict(enumerate(s.tolist())), k, metric == "inner_product")
    return out


def same_hits(a, b):
    assert {q: [x[:2] for x in h] for q, h in a.items()} == {q: [x[:2] for x in h] for q, h in b.items()}
    for q in a:
        assert np.allclose([x[2] for x in a[q]], [x[2] for x in b[q]], atol=1e-5)


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
def test_exact_search(vectors, points, metric):
    same_hits(hits_of(dense.dense_topk(asked(vectors), vectors, 6, metric)), exact(points, 6, metric))
    same_hits(hits_of(dense.dense_topk_block(asked(vectors), vectors, 6, metric)), exact(points, 6, metric))


@pytest.mark.parametrize("search", [dense.dense_topk, dense.dense_topk_block])
def test_null_vectors_are_left_out(spark, vectors, points, search):
    nulls = spark.createDataFrame([(500, None, 0)], vectors.schema)
    with_null = vectors.union(nulls)
    q = asked(vectors).union(nulls.withColumnRenamed("doc_id", "qid"))
    same_hits(hits_of(search(q, with_null, 6)), exact(points, 6, "inner_product"))


@pytest.mark.parametrize("step", [1, 50])
def test_scores_are_made_in_slices(vectors, points, monkeypatch, step):
    monkeypatch.setattr(dense, "SCORES_AT_ONCE", step)
    q, p = points[:25].astype(float), points.astype(float)
    got = dense.best_hits(np.arange(25), q, np.arange(len(p))[::-1], p[::-1], 6, "inner_product")
    want = exact(points, 6, "inner_product")
    assert {i: set(g["doc_id"]) for i, g in got.groupby("qid")} == {i: {x[1] for x in h} for i, h in want.items()}


def test_many_questions_go_to_blocks(vectors, points, monkeypatch):
    monkeypatch.setattr(dense, "BROADCAST_VECTORS", 3)
    same_hits(hits_of(dense.dense_topk(asked(vectors), vectors, 6)), exact(points, 6, "inner_product"))


def test_a_large_cell_is_cut_into_blocks(vectors, points):
    from pyspark.sql import functions as F

    q = asked(vectors).select("qid", F.col("embedding").alias("v"), F.lit(0).alias("cell"))
    p = vectors.select("doc_id", F.col("embedding").alias("v"), F.lit(0).alias("cell"))
    same_hits(hits_of(dense.cell_topk(q, p, 6, "inner_product", 4, 10)), exact(points, 6, "inner_product"))


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
def test_probing_every_cell_is_exact(vectors, points, metric):
    centroids, cells = ivf.ivf_build(vectors.drop("label"), 5, "l2")
    got = hits_of(ivf.ivf_topk(asked(vectors), centroids, cells, 6, 5, metric))
    same_hits(got, exact(points, 6, metric))


def test_ivf_assigns_the_nearest_centroid(vectors):
    centroids, cells = ivf.ivf_build(vectors.drop("label"), 5, "l2")
    c = {r.cluster_id: np.array(r.centroid) for r in centroids.collect()}
    for r in cells.collect():
        d = {i: ((np.array(r.embedding) - v) ** 2).sum() for i, v in c.items()}
        assert d[r.cluster_id] <= min(d.values()) + 1e-6


def test_ivf_store(spark, vectors, tmp_path):
    first = stored.ivf_store(spark, str(tmp_path), vectors.drop("label"), 4, "l2")
    again = stored.ivf_store(spark, str(tmp_path), vectors.drop("label"), 4, "l2")
    assert sorted(map(tuple, first[0].select("cluster_id").collect())) == sorted(map(tuple, again[0].select("cluster_id").collect()))


@pytest.mark.parametrize("values_at_once", [8_000_000, 90])
def test_lsa_in_blocks_of_columns(spark, texts, corpus, questions, monkeypatch, values_at_once):
    monkeypatch.setattr(lsa, "VALUES_AT_ONCE", values_at_once)
    monkeypatch.setattr(lsa, "TERMS_A_ROW", 7)
    model = tfidf.tfidf_fit(corpus, 30)
    _, vector = tfidf_vectors(texts, 30)
    rows = np.array([[vector(t).get(g, 0.0) for g in model.terms] for t in texts.values()])
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    fitted = lsa.lsa_fit(corpus, model, 6, tolerance=1e-13)
    assert np.allclose(fitted.singular_values, s[:6])
    v = np.zeros((len(model.terms), 6))
    for r in fitted.components.collect():
        v[r.term] = r.component
    assert np.allclose(v.T @ v, np.eye(6)) and np.allclose(np.abs(vt[:6] @ v), np.eye(6), atol=1e-4)
    got = {r.doc_id: r.embedding for r in lsa.lsa_vectors(corpus, fitted).collect()}
    assert np.allclose([got[i] for i in texts], rows @ v)


def test_lsa_of_a_low_rank_and_of_nothing(spark):
    corpus = spark.createDataFrame([(i, "a b a b" if i % 2 else "c") for i in range(9)] + [(9, "")], "doc_id long, text string")
    model = tfidf.tfidf_fit(corpus, 20)
    fitted = lsa.lsa_fit(corpus, model, 10)
    assert np.allclose(fitted.singular_values, np.sqrt([5, 4, 1]))
    assert len(fitted.components.first().component) == 3
    none = lsa.lsa_fit(corpus.limit(0), tfidf.tfidf_fit(corpus.limit(0), 20), 10)
    assert none.singular_values == [] and none.components.count() == 0
    assert lsa.lsa_vectors(corpus, none).count() == 10


def test_quantised_values_stay_close(vectors, points):
    coded = ivf.scalar_quantize(vectors, 8)
    decoded = ivf.scalar_decode(coded, ivf.quantizer_bounds(vectors), 8).collect()
    width = points.max(axis=0) - points.min(axis=0)
    for r in decoded:
        assert np.all(np.abs(np.array(r.decoded) - points[r.doc_id]) <= width / 255 / 2 + 1e-6)


def test_hash_encoder_is_unit_length_and_reads_whole_texts():
    run = dense.hash_encoder(16)()
    a, b, none = run(np.array(["x y z", "x y z " * 50, None], dtype=object))
    assert math.isclose((a * a).sum(), 1.0, rel_tol=1e-5) and not np.allclose(a, b) and not none.any()


def test_hybrid_drops_dense_only_documents(spark):
    schema = "qid long, rank long, doc_id long, score double"
    s = spark.createDataFrame([(1, 1, 10, 2.0), (1, 2, 11, 1.9)], schema)
    d = spark.createDataFrame([(1, 1, 11, 30.0), (1, 2, 99, 50.0)], schema)
    assert hits_of(fusion.hybrid_topk(s, d, 5)) == {1: [(1, 11, 2.2), (2, 10, 2.0)]}


def test_context_and_gold(spark, corpus, texts):
    examples = spark.createDataFrame(
        [("a", "rare owl", texts[0], ([0], ["x"])), ("b", "nothing known", texts[1], ([], []))],
        "id string, question string, context string, answers struct<answer_start:array<int>,text:array<string>>",
    )
    rows = {r.id: r for r in retrieval.retrieve(examples, corpus, "bm25", retrieval.Options(k=3)).collect()}
    want = " ".join(texts[i] for _, i, _ in best(bm25_scores(texts, "rare owl"), 3))
    assert rows["a"].context == want and rows["a"].original_context == texts[0] and rows["b"].context == ""
    plain = retrieval.reader_input(examples.select("id", "question"), corpus)
    assert plain.columns == ["context", "id", "question"] and {t for _, t in plain.dtypes} == {"string"}


@pytest.mark.parametrize("kind", retrieval.KINDS)
def test_every_retriever_runs(corpus, questions, kind):
    options = retrieval.Options(k=3, max_features=30, lsa_components=4, num_clusters=3, nprobe=2)
    rows = retrieval.find(questions.where("qid <> 2"), corpus, kind, options).collect()
    assert rows and max(r["rank"] for r in rows) <= 3
    with pytest.raises(ValueError):
        retrieval.find(questions, corpus, "other")


def test_recall_is_monotone(spark, corpus, questions):
    hits = sparse.bm25_topk(questions, sparse.bm25_index(corpus), 50)
    gold = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 8), (4, 9)], "qid long, doc_id long")
    recall = [r.recall for r in metrics.recall_at_k(hits, gold).orderBy("k").collect()]
    assert recall == sorted(recall) and len(recall) == 5
    detail = {r.qid: r for r in metrics.recall_detail(hits, gold).collect()}
    assert detail[2].is_in == 0 and detail[2].top_ids == ""


def test_hard_negatives_leave_out_the_gold_passage(spark, texts, corpus):
    gold = texts[3]
    examples = spark.createDataFrame([("e", gold.replace(" ", "\n")), ("f", "unknown")], "id string, context string")
    rows = {r.id: r for r in hard_negatives(examples.union(spark.createDataFrame([("g", gold)], examples.schema)), corpus, sparse.bm25_index(corpus)).collect()}
    order = [texts[i] for _, i, _ in best(bm25_scores(texts, gold), 4)]
    want = [t for t in order if t.replace(" ", "") != gold.replace(" ", "")][:3]
    assert [rows["g"].passage_top1, rows["g"].passage_top2, rows["g"].passage_top3] == want
    assert rows["f"].passage_top1 == rows["f"].passage_top3 == "None"


def test_hard_negatives_keep_examples_without_context(spark, texts, corpus):
    examples = spark.createDataFrame([("e", None), ("f", None), ("g", texts[3])], "id string, context string")
    rows = {r.id: r for r in hard_negatives(examples, corpus, sparse.bm25_index(corpus)).collect()}
    assert set(rows) == {"e", "f", "g"} and rows["g"].passage_top1 != "None"
    assert all(rows[i][f"passage_top{k}"] == "None" for i in "ef" for k in (1, 2, 3))


def test_positions_are_row_numbers(spark):
    ids = random.Random(5).sample(range(10000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = {r.id: r.position for r in ranking.with_position(df, "id", 7).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}
    names = [f"n{i}" for i in ids]
    df = spark.createDataFrame([(i,) for i in names], "id string").repartition(3)
    got = {r.id: r.position for r in ranking.with_position(df, "id", 7).collect()}
    assert got == {i: n for n, i in enumerate(sorted(names))}


@pytest.mark.parametrize("phrases_per_pass", [100, 2])
def test_containing_has_no_word_rule(spark, phrases_per_pass):
    passages = [(1, "one two three four fives"), (2, "x four five"), (3, None), (4, "")]
    phrases = [(1, "one two three four five"), (2, "four five"), (3, "e"), (4, ""), (5, None), (6, "four five")]
    got = containing(
        spark.createDataFrame(phrases, "qid long, question string"), spark.createDataFrame(passages, "doc_id long, text string"), phrases_per_pass
    )
    want = {(q, d) for q, p in phrases for d, t in passages if p is not None and t is not None and p in t}
    assert sorted((r.qid, r.doc_id) for r in got.collect()) == sorted(want)


def test_vocabulary_edge_is_exact(spark):
    texts = ["a a a b b c", "b c d", "e d c", "f g h i"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(g for t in texts for w in [t.split(" ")] for g in w + [f"{x} {y}" for x, y in zip(w, w[1:])])
    for n in (1, 3, 4, 7, 100):
        want = sorted(counts, key=lambda g: (-counts[g], g))[:n]
        assert {r.term for r in tfidf.tfidf_vocab(corpus, n).collect()} == set(want)


def test_assignment_has_no_centroid_cap(spark, points, vectors):
    centroids = ivf.ivf_fit(vectors, 9, "l2")
    whole = {r.doc_id: r.cluster_id for r in ivf.ivf_assign(vectors, centroids, "l2").collect()}
    parts = {r.doc_id: r.cluster_id for r in ivf.ivf_assign(vectors, centroids, "l2", values_at_once=20).collect()}
    assert whole == parts and len(whole) > 0


def test_stored_lsa_and_clusters_over_it(spark, tmp_path, corpus, questions):
    model, rows = stored.tfidf_store(spark, str(tmp_path), corpus, 40)
    fitted, projected = stored.lsa_store(spark, str(tmp_path), corpus, model, 4)
    cells = stored.ivf_store(spark, str(tmp_path), projected, 3, encoder_name="lsa4")
    options = retrieval.Options(k=3, tfidf=model, tfidf_rows=rows, lsa=fitted, lsa_vectors=projected, ivf=cells, ivf_over="lsa", nprobe=3)
    fresh = hits_of(lsa.lsa_topk(questions, corpus, fitted, 3))
    assert hits_of(retrieval.find(questions, corpus, "lsa", options)) == fresh
    assert set(hits_of(retrieval.find(questions, corpus, "ivf", options))) == set(fresh)
    assert hits_of(retrieval.find(questions, corpus, "tfidf", options)) == hits_of(tfidf.tfidf_topk(questions, corpus, model, 3))


def test_packed_codes_score_like_the_vectors_they_stand_for():
    rng = np.random.default_rng(4)
    vectors, asked = rng.normal(size=(200, 7)), rng.normal(size=(5, 7))
    lo, hi = vectors.min(0), vectors.max(0)
    lo[2] = hi[2] = 0.5
    for bits, width in ((8, 7), (4, 4)):
        steps = quantized.Steps(lo, hi, bits)
        codes = steps.encode(vectors)
        decoded = steps.decode(codes)
        assert codes.dtype == np.uint8 and codes.shape == (200, width)
        others = [0, 1, 3, 4, 5, 6]
        assert (np.abs(decoded - vectors)[:, others] <= ((hi - lo) / (2 * steps.levels) + 1e-12)[others]).all()
        for metric in ("inner_product", "l2"):
            assert np.allclose(steps.scores(asked, codes, metric), dense.similarity(asked, decoded, metric))
        far = steps.decode(steps.encode(np.array([hi + 100, lo - 100, [np.nan] * 7])))
        assert np.allclose(far, [hi, lo, lo])


def plain_coded_hits(index, points, nprobe, k):
    """Top k by decoded codes within the nearest cells, in plain Python."""
    steps = quantized.steps_of(index.bounds, index.bits)
    centers = {r.cluster_id: np.array(r.centroid) for r in index.centroids.collect()}
    cells = [(r.doc_id, r.cluster_id, steps.decode(np.frombuffer(r.code, np.uint8)[None])[0]) for r in index.cells.collect()]
    way = -1 if index.metric == "inner_product" else 1
    score = lambda a, b: float(a @ b) if way < 0 else float(((a - b) ** 2).sum())
    out = set()
    for q, v in points.items():
        near = {c for _, c in sorted((way * round(score(v, m), 6), c) for c, m in centers.items())[:nprobe]}
        best = sorted((way * round(score(v, x), 6), i) for i, c, x in cells if c in near)[:k]
        out |= {(q, rank, i) for rank, (_, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("metric", "bits"), [("inner_product", 8), ("l2", 4)])
def test_quantised_cells(spark, vectors, points, tmp_path, metric, bits):
    plain = vectors.select("doc_id", "embedding")
    index = stored.ivf_quantized_store(spark, str(tmp_path), plain, 4, metric, bits)
    again = stored.ivf_quantized_store(spark, str(tmp_path), plain, 4, metric, bits)
    assert index.cells.count() == again.cells.count() == len(points)
    code = index.cells.first().code
    assert 4 * len(code) <= points[0].nbytes and (bits == 8 or 8 * len(code) <= points[0].nbytes)
    asked_for = {q: points[q].astype(float) for q in range(0, 25, 3)}
    got = quantized.quantized_topk(asked(vectors).where("qid % 3 = 0"), again, 5, 2).collect()
    assert {(r.qid, r.rank, r.doc_id) for r in got} == plain_coded_hits(index, asked_for, 2, 5)
    q, v = next(iter(asked_for.items()))
    one = quantized.quantized_search(spark, v.tolist(), again, 5, 2)
    assert {(q, r.rank, r.doc_id) for r in one.collect()} == plain_coded_hits(index, {q: v}, 2, 5)
    assert "PartitionFilters: [cluster_id" in one._jdf.queryExecution().executedPlan().toString()


def test_given_bounds_and_centroids_are_used(spark, vectors, points):
    centroids = ivf.ivf_fit(vectors, 3, "l2")
    bounds = spark.createDataFrame([([-0.1] * len(points[0]), [0.1] * len(points[0]))], "lo array<double>, hi array<double>")
    index = quantized.quantized_build(vectors.select("doc_id", "embedding"), metric="l2", centroids=centroids, bounds=bounds)
    steps = quantized.steps_of(index.bounds, 8)
    for r in index.cells.collect():
        assert np.allclose(steps.decode(np.frombuffer(r.code, np.uint8)[None])[0], np.clip(points[r.doc_id], -0.1, 0.1), atol=0.2 / 255)
    clipped = ivf.scalar_quantize(vectors, 4, bounds=bounds).selectExpr("array_max(codes) AS hi", "array_min(codes) AS lo").agg({"hi": "max", "lo": "min"})
    assert tuple(clipped.first()) in ((15, 0), (0, 15))
    with pytest.raises(ValueError):
        quantized.steps_of(bounds, 3)


def test_digest_follows_the_rows_and_not_their_order(spark, corpus):
    rows = corpus.select("doc_id", "text")
    assert stored.digest_of(rows) == stored.digest_of(rows.repartition(7).orderBy("text"))
    assert len({stored.digest_of(x) for x in (rows, rows.limit(5), rows.union(rows.limit(1)), rows.where("doc_id > 0"))}) == 4


def test_an_index_of_other_rows_is_built_anew(spark, corpus, tmp_path):
    where = str(tmp_path)
    few = corpus.where("doc_id < 9")
    stamps = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert stored.bm25_store(spark, where, corpus, buckets=2).docs.count() == corpus.count()
    before = stamps()
    stored.bm25_store(spark, where, corpus.repartition(5), buckets=2)
    assert stamps() == before
    assert stored.bm25_store(spark, where, few, buckets=2).docs.count() == few.count()
    # not compared on demand
    assert stored.tfidf_store(spark, where, corpus, 20, check=False)[1].count() == corpus.count()
    assert stored.tfidf_store(spark, where, few, 20, check=False)[1].count() == corpus.count()
    assert stored.tfidf_store(spark, where, few, 20)[1].count() == few.count()


def test_another_encoder_is_another_index(spark, corpus, tmp_path):
    few = corpus.where("doc_id < 9")
    first = stored.vectors_store(spark, str(tmp_path), few)
    with pytest.raises(ValueError):
        stored.vectors_store(spark, str(tmp_path), few, dense.hash_encoder(16))
    second = stored.vectors_store(spark, str(tmp_path), few, dense.hash_encoder(16), encoder_name="hash16")
    assert len(first.first().embedding) == 64 and len(second.first().embedding) == 16
    assert stored.vectors_store(spark, str(tmp_path), corpus).count() == corpus.count()

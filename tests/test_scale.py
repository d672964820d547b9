"""What a task holds, sends or repeats follows its own rows, not the whole table."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lectern.functions import batch
from lectern.operators import dense, lsa, quantized, sparse, tfidf
from lectern.plans import retrieval


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    return {i: " ".join(rng.choices(common, weights=range(1, 31), k=20) + [f"only{i}", "", f"Once{i}"]) for i in range(300)}


@pytest.fixture(scope="module")
def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").persist()


def grams(text):
    words = text.lower().split(" ")
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_only_terms_that_can_be_in_the_vocabulary_are_brought_together(corpus, texts, monkeypatch):
    monkeypatch.setattr(tfidf, "TOKENS_COUNTED", 3000)
    tokens = corpus.coalesce(1).selectExpr("split(lower(text), ' ') AS tokens")
    totals = Counter(g for t in texts.values() for g in grams(t))
    found = {r.term for r in tfidf._frequent(tokens, 40).collect()}
    best = sorted(totals, key=lambda g: (-totals[g], g))[:40]
    assert set(best) <= found and len(found) < len(totals) / 2
    vocab = {r.term: (r.total, r.df) for r in tfidf.tfidf_vocab(corpus, 40).collect()}
    df = Counter(g for t in texts.values() for g in set(grams(t)))
    assert vocab == {g: (totals[g], df[g]) for g in best}


def test_all_terms_are_kept_where_they_are_few(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "TOKENS_COUNTED", 2)
    few = spark.createDataFrame([(1, "a b"), (2, "b  a"), (3, ""), (4, None)], "doc_id long, text string")
    vocab = {r.term: (r.total, r.df) for r in tfidf.tfidf_vocab(few, 50).collect()}
    assert vocab == {"a": (2, 2), "b": (2, 2), "": (2, 2), "a b": (1, 1), "b ": (1, 1), " a": (1, 1)}


def test_slices_are_bounded_and_lose_no_row():
    tokens = pa.array([["a"] * n for n in (3, 0, 9, 1, 1, 1, 2)] + [None], pa.list_(pa.string()))
    one = pa.RecordBatch.from_arrays([tokens, pa.array(range(8))], names=["tokens", "id"])
    parts = list(tfidf._slices(iter([one, one]), 4))
    assert [i for p in parts for i in p.column("id").to_pylist()] == [*range(8)] * 2
    assert max(len(p.column("tokens").flatten()) for p in parts if p.num_rows > 1) <= 4


def test_a_small_rest_goes_with_the_slice_before():
    tokens = pa.array([["a"] * n for n in (4, 4, 1)], pa.list_(pa.string()))
    parts = tfidf._no_small_rest(tfidf._slices(iter([pa.RecordBatch.from_arrays([tokens], names=["tokens"])]), 4), 2)
    assert [p.num_rows for p in parts] == [1, 2]


def test_lsa_takes_stored_rows_and_few_tasks(spark, corpus):
    model = tfidf.tfidf_fit(corpus, 40)
    rows = tfidf.tfidf_rows(corpus.repartition(30), model).persist()
    fitted = lsa.lsa_fit(corpus, model, 5, rows=rows)
    assert fitted.singular_values == pytest.approx(lsa.lsa_fit(corpus, model, 5).singular_values, rel=1e-3)


def test_best_by_sql_makes_no_row_per_component(spark):
    rng = np.random.default_rng(1)
    q, d = rng.standard_normal((3, 6)), rng.standard_normal((50, 6))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9, [])], "qid long, embedding array<double>")
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, embedding array<double>")
    best = entry._best_by_sql(asked, given, 4)
    assert "Generate" not in best._jdf.queryExecution().toString()
    want = {(i, r + 1): s for i, row in enumerate(q @ d.T) for r, s in enumerate(sorted(row, reverse=True)[:4])}
    assert {(r.qid, r["rank"]): r.plain for r in best.collect()} == pytest.approx(want)


@pytest.mark.parametrize("share", [1, 7, 10**9])
def test_best_by_sql_sorts_only_pairs_that_reach_the_bound(spark, monkeypatch, share):
    """Pairs are the rows of a join; without a bound all 2,400 of them were sorted."""
    rng = np.random.default_rng(4)
    q, d = rng.standard_normal((4, 5)), np.round(rng.standard_normal((600, 5)), 1)
    d[300:] = d[:300]
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<double>")
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)] + [(900, []), (901, None)], "doc_id long, embedding array<double>")
    monkeypatch.setattr(entry, "BOUND_SHARE", share)
    rows, top = [], entry.top_k
    monkeypatch.setattr(entry, "top_k", lambda pairs, *a: rows.append(pairs.count()) or top(pairs, *a))
    best = {(r.qid, r["rank"]): r.plain for r in entry._best_by_sql(asked, given, 3).collect()}
    want = {(i, r + 1): s for i, row in enumerate(q @ d.T) for r, s in enumerate(sorted(row, reverse=True)[:3])}
    assert best == pytest.approx(want) and rows[0] == {1: 2400, 7: rows[0], 10**9: 0}[share]
    assert rows[1] < 400 if share < 10 else rows[1] == 2400
    monkeypatch.undo()
    assert not entry._best_by_sql(asked.limit(0), given, 3).count()


def test_products_of_a_common_term_are_made_in_slices(monkeypatch):
    import pandas as pd

    rows = pd.DataFrame({"qid": np.repeat(np.arange(50), 3), "key": np.tile([1, 2, 3], 50), "qw": np.arange(150.0)})
    asked = sparse.Questions(rows)
    keys, weights, owner = np.tile([1, 3, 7], 40), np.arange(120.0), np.repeat(np.arange(40), 3)
    whole = asked.scores(keys, weights, owner, 40)
    made, repeat = [], np.repeat
    monkeypatch.setattr(sparse, "PRODUCTS_AT_ONCE", 100)
    monkeypatch.setattr(sparse.np, "repeat", lambda a, n, *r: made.append(np.sum(n)) or repeat(a, n, *r))
    sliced = asked.scores(keys, weights, owner, 40)
    assert max(made) <= 100
    assert np.allclose(whole[0], sliced[0]) and (whole[1] == sliced[1]).all()


def test_passes_over_the_documents_run_one_after_another(spark, monkeypatch):
    rng = random.Random(3)
    asked = [(f"q{i % 9}", i // 9, rng.random()) for i in range(90)]
    docs = [(d, [*range(d % 7, 10)], [rng.random() for _ in range(d % 7, 10)]) for d in range(30)]
    questions = spark.createDataFrame(asked, "qid string, key long, qw double")
    table = spark.createDataFrame(docs, "doc_id long, keys array<long>, weights array<double>")
    whole = {tuple(r) for r in sparse.sparse_topk(questions, table, 4).collect()}
    steps, collected, written = [], sparse._collected, sparse.materialized
    monkeypatch.setattr(sparse, "_collected", lambda df: steps.append("load") or collected(df))
    monkeypatch.setattr(sparse, "materialized", lambda df, label: steps.append(label) or written(df, label))
    destroy = sparse.Broadcast.destroy
    monkeypatch.setattr(sparse.Broadcast, "destroy", lambda b: steps.append("gone") or destroy(b))
    got = sparse.sparse_topk(questions, table, 4, terms_per_pass=30)
    assert steps == ["questions", "weights", *["load", "hits", "gone"] * 3]
    found = {(r.qid, r["rank"]): (r.doc_id, round(r.score, 9)) for r in got.collect()}
    assert found == {(q, r): (d, round(s, 9)) for q, r, d, s in whole} and len(found) == 36


def test_terms_at_the_driver_hold_an_id_once(spark):
    rows = [("a" * 50, 7, 0.5), ("b", 3, 1.0), ("a" * 50, 3, 2.0)]
    got = sparse._collected(spark.createDataFrame(rows, "qid string, key long, qw double"))
    assert [*map(tuple, got.astype({"qid": object}).to_numpy().tolist())] == rows and str(got["qid"].dtype) == "category"
    asked = sparse.Questions(got)
    assert asked.ids.tolist() == ["b", "a" * 50] and asked.keys.tolist() == [3, 7] and asked.number.tolist() == [0, 1, 1]
    assert not len(sparse.Questions(sparse._collected(spark.createDataFrame([], "qid long, key long, qw double"))).ids)


def test_a_side_has_few_blocks(spark):
    blocks = lambda n, per: spark.range(1).select(dense._blocks(entry.F.lit(n), per)).first()[0]
    assert [blocks(n, 1024) for n in (0, 10, 5000, 600_000, 10_000_000)] == [1, 1, 5, 8, 77]
    assert blocks(40_000, 16384) == 3


def test_questions_of_a_large_block_are_scored_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    q, p = rng.standard_normal((40, 4)), rng.standard_normal((70, 4))
    args = np.arange(40), q, np.arange(70), p, 5, "l2"
    whole = dense.best_hits(*args)
    seen, similarity = [], dense.similarity
    monkeypatch.setattr(dense, "QUESTIONS_AT_ONCE", 7)
    monkeypatch.setattr(dense, "similarity", lambda a, b, m: seen.append(len(a)) or similarity(a, b, m))
    sliced = dense.best_hits(*args)
    order = ["qid", "score", "doc_id"]
    assert max(seen) <= 7
    assert whole.sort_values(order).reset_index(drop=True).round(9).equals(sliced.sort_values(order).reset_index(drop=True).round(9))


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
def test_later_passages_are_ranked_only_where_they_reach_the_bound(monkeypatch, metric):
    rng = np.random.default_rng(6)
    q, p = np.round(rng.standard_normal((9, 3)), 1), np.round(rng.standard_normal((400, 3)), 1)
    args = np.array([f"q{i}" for i in range(9)], object), q, rng.permutation(400), p, 5, metric
    whole = dense.best_hits(*args)
    ranked, smallest = [], dense._smallest
    monkeypatch.setattr(dense, "SCORES_AT_ONCE", 9 * 40)
    monkeypatch.setattr(dense, "_smallest", lambda keys, k: ranked.append(len(keys)) or smallest(keys, k))
    sliced = dense.best_hits(*args)
    assert len(ranked) < 9 * 10
    plain = lambda hits: {(r.qid, r.doc_id, round(r.score, 9)) for r in hits.itertuples()}
    assert plain(sliced) == plain(whole) and len(plain(whole)) == 45


@pytest.mark.parametrize("bits", [4, 8])
def test_inner_products_of_codes_are_products_of_matrices(monkeypatch, bits):
    rng = np.random.default_rng(8)
    steps = quantized.Steps(rng.standard_normal(5) - 3, rng.standard_normal(5) + 3, bits)
    codes, asked = steps.encode(rng.standard_normal((70, 5))), rng.standard_normal((12, 5))
    want = np.transpose(sum(t.take(codes[:, i], axis=0) for i, t in enumerate(steps.tables(asked, "inner_product"))))
    decoded, decode = [], quantized.Steps.decode
    monkeypatch.setattr(quantized, "VALUES_AT_ONCE", 40)
    monkeypatch.setattr(quantized.Steps, "decode", lambda s, c: decoded.append(len(c)) or decode(s, c))
    assert np.allclose(steps.scores(asked, codes, "inner_product"), want, atol=1e-12)
    assert max(decoded) == 8 and sum(decoded) == 70


def test_a_batch_is_tokenized_in_slices(monkeypatch):
    texts, seen = pa.array(["ab cd", None, "x" * 30, "", "é f"]), []

    def tokenize(values):
        seen.append(sum(map(len, values)))
        return [[(i, i + 1) for i in range(len(v))] for v in values]

    whole = batch._spans(texts, tokenize)
    monkeypatch.setattr(batch, "CHARACTERS_AT_ONCE", 8)
    del seen[:]
    assert batch._spans(texts, tokenize).equals(whole) and max(s for s in seen if s != 30) <= 8 and len(seen) > 1
    assert len(batch._spans(texts.slice(0, 0), tokenize)) == 0


def test_examples_of_one_question_share_its_search(spark, corpus, monkeypatch):
    asked, find = [], retrieval.find
    monkeypatch.setattr(retrieval, "find", lambda questions, *a: asked.append(questions.count()) or find(questions, *a))
    rows = [(f"e{i}", ("w1 w2", "only7", None)[i % 3]) for i in range(12)] + [(None, "w1 w2")]
    examples = spark.createDataFrame(rows, "id string, question string")
    out = retrieval.retrieve(examples, corpus).collect()
    assert asked == [2] and len(out) == 13
    by_id = {r.id: r.context for r in out}
    assert by_id["e1"] == by_id["e4"] and "only7" in by_id["e1"] and by_id["e2"] == "" and by_id[None] == ""
    assert by_id["e0"] == by_id["e3"] != ""

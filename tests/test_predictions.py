import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ensemble, metrics, profile
from lectern.session import new_dir, shared_dir
from lectern.sources import readers, writers


def answers(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id string, text string")


def nbest(spark, rows):
    flat = [(i, r, t, p) for i, entries in rows.items() for r, (t, p) in enumerate(entries, 1)]
    return spark.createDataFrame(flat, "id string, rank long, text string, probability double")


def test_agreement_and_differences(spark):
    a, b, c = answers(spark, {"1": "x", "2": "y", "3": "z"}), answers(spark, {"1": "x", "2": "n", "4": "w"}), answers(spark, {"1": "q", "2": "q", "3": "z"})
    row = ensemble.agreement(a, b).first()
    assert (row.n, row.agreement) == (4, 0.25)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(ensemble.differences(a, b)) == ["2", "3", "4"]
    assert ids(ensemble.differs_from_all(a, [b, c])) == ["2"]
    assert ids(ensemble.differs_from_any(a, [b, c])) == ["1", "2", "3", "4"]
    table = ensemble.side_by_side({"a": a, "b": b, "c": c}, ("a", "b")).collect()
    assert [tuple(r) for r in table] == [("2", "y", "n", "q")]


def test_override_rules(spark):
    base = {"low": [("x", 0.3)], "led": [("x", 0.4)], "out": [("x", 0.5)], "keep": [("x", 0.9)], "same": [("x", 0.1)]}
    partner = {"low": [("y", 0.3)], "led": [("y", 0.9)], "out": [("x", 0.5)], "keep": [("y", 0.9)], "same": [("x", 0.8)]}
    other = {"low": [("z", 0.2)], "led": [("z", 0.76)], "out": [("z", 0.81)], "keep": [("z", 0.95)], "same": [("x", 0.9)]}
    fourth = {i: [("f", 0.85)] for i in base}
    table = ensemble.combined({"a": nbest(spark, base), "b": nbest(spark, partner), "c": nbest(spark, other), "d": nbest(spark, fourth), "e": nbest(spark, base)})
    ruled = ensemble.ensemble_rules(table, "a", "b", "c")
    flags = {r.id: (r.rule1, r.rule2, r.rule3) for r in ruled.collect()}
    assert flags == {
        "low": (True, False, False), "led": (False, True, False), "out": (False, False, True),
        "keep": (False, False, False), "same": (False, False, False),
    }
    assert {r.id: r.text for r in ensemble.ensemble_apply(ruled, "a", "c").collect()} == {"low": "z", "led": "z", "out": "z", "keep": "x", "same": "x"}
    more = {r.id: (r.rule4, r.rule5) for r in ensemble.ensemble_flags(table, "a", "d", "e").collect()}
    assert more == {"low": (True, False), "led": (True, False), "out": (False, False), "keep": (False, False), "same": (True, False)}


def test_confidence(spark):
    a = ensemble.max_probability(nbest(spark, {"1": [("x", 0.2), ("y", 0.6)], "2": [("x", 0.9)]}))
    b = ensemble.max_probability(nbest(spark, {"1": [("x", 0.4)], "2": [("x", 0.5)]}))
    assert {r.id: round(r.probability, 9) for r in ensemble.pair_confidence(a, b).collect()} == {"1": 0.5, "2": 0.7}
    row = ensemble.confidence_summary(a, (0.5, 0.7)).first()
    assert (row.n, row.min_p, row.max_p, row.below_50, row.below_70) == (2, 0.6, 0.9, 0, 1)


def f1(p, r):
    p, r = p.split(), r.split()
    same = sum((Counter(p) & Counter(r)).values())
    return 0.0 if not same else 2 * same / (len(p) + len(r))


def test_answer_scores(spark):
    cases = {
        "1": ("The Cat", ["cat", "dog"]), "2": ("서울 특별시", ["서울", "서울 시"]), "3": ("", ["", "x"]),
        "4": ("a b b c", ["b b b d"]), "5": ("🙂 x", ["x 🙂"]), "6": ("none", ["other"]),
    }
    p = spark.createDataFrame([(i, x) for i, (x, _) in cases.items()], "id string, prediction_text string")
    r = spark.createDataFrame([(i, t) for i, (_, t) in cases.items()], "id string, texts array<string>")
    got = {x.id: (x.em, round(x.f1, 9)) for x in metrics.squad_scores(p, r).collect()}
    clean = lambda s: " ".join(w for w in s.lower().split() if w not in ("a", "an", "the"))
    for i, (x, refs) in cases.items():
        want = max(float(clean(x) == clean(t)) for t in refs), round(max(f1(clean(x), clean(t)) for t in refs), 9)
        assert got[i] == want
    total = metrics.squad_metrics(p, r).first()
    assert math.isclose(total.exact_match, 100 * sum(e for e, _ in got.values()) / 6)


def test_losses(spark):
    rng = np.random.default_rng(1)
    q, p, h = (rng.normal(size=(8, 4)) for _ in range(3))
    rows = [(i // 4, i, q[i].tolist(), p[i].tolist(), h[i].tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "batch long, item long, q array<double>, p array<double>, h array<double>").repartition(3)
    for hard in (None, "h"):
        got = {r.batch: r.loss for r in metrics.in_batch_nll(df, hard=hard).collect()}
        for b in range(2):
            s = slice(4 * b, 4 * b + 4)
            scores = q[s] @ (p[s] if hard is None else np.vstack([p[s], h[s]])).T
            want = np.mean([np.log(np.exp(scores[i]).sum()) - scores[i, i] for i in range(4)])
            assert math.isclose(got[b], want, rel_tol=1e-9)
    big = spark.createDataFrame([(1000.0,)], "loss double")
    assert metrics.perplexity(big).first()[0] == math.inf
    acc = spark.createDataFrame([(1, 1), (2, 1), (5, -100)], "prediction int, label int")
    assert tuple(metrics.masked_accuracy(acc).first()) == (2, 0.5)


def test_best_so_far(spark):
    rows = [("top10", e, v) for e, v in enumerate([0.0, 5.0, 5.0, 4.0, 7.0])]
    got = metrics.best_so_far(spark.createDataFrame(rows, "metric string, epoch int, value double"))
    assert sorted((r.epoch, r.earlier_best) for r in got.collect()) == [(1, 0.0), (4, 5.0)]


def test_histogram(spark):
    df = spark.createDataFrame([("x" * n,) for n in [1, 1, 2, 5, 11]], "text string")
    got = {r.bin: r.n for r in profile.length_histogram(df, profile.char_length()).collect()}
    assert [got[i] for i in range(10)] == np.histogram([1, 1, 2, 5, 11], bins=10)[0].tolist()
    flat = profile.length_histogram(spark.createDataFrame([("ab",), ("cd",)], "text string"), profile.char_length()).collect()
    assert {r.bin: r.n for r in flat}[5] == 2


def test_contains_accuracy(spark):
    df = spark.createDataFrame([("xx 가나 y", "가나"), ("x", "y")], "context string, original_context string")
    assert tuple(metrics.contains_accuracy(df).first()) == (2, 50.0)


TRICKY = {"1": "it's \"quoted\"", "2": "줄\n바꿈 😀", "3": "", "4": "back\\slash, comma"}


@pytest.mark.parametrize("single", [False, True])
def test_prediction_files(spark, tmp_path, single):
    path = writers.write_predictions(answers(spark, TRICKY), str(tmp_path), writers.run_prefix(50000, clusters=64, metric="l2"), single)
    assert path.endswith("predictions_tfidf50000_faiss64_l2.json")
    assert {r.id: r.text for r in readers.read_predictions(spark, path, whole_file=False).collect()} == TRICKY
    if single:
        lines = [line for f in (tmp_path / path).glob("part-*") for line in f.read_text().splitlines()]
        assert len(lines) == 1 and json.loads(lines[0]) == TRICKY


def test_one_object_from_many_tasks(spark, tmp_path):
    many = {str(i): f'text {i} "{{}}", \n' for i in range(500)}
    df = answers(spark, many).repartition(7)
    path = writers.write_predictions(df, str(tmp_path), "many", single=True)
    assert [f.name for f in (tmp_path / path).iterdir() if not f.name.startswith(".")] == ["part-00000.json"]
    assert json.loads((tmp_path / path / "part-00000.json").read_text()) == many
    assert {r.id: r.text for r in readers.read_predictions(spark, path).collect()} == many
    # written again in its place, and without a row
    again = writers.write_predictions(df.limit(0), str(tmp_path), "many", single=True)
    assert again == path and json.loads((tmp_path / path / "part-00000.json").read_text()) == {}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["predictions_many.json"]


def test_pretty_printed_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(TRICKY, indent=4, ensure_ascii=False))
    assert {r.id: r.text for r in readers.read_predictions(spark, str(tmp_path / "p.json")).collect()} == TRICKY
    entries = {"q": [{"text": "a", "start_logit": 1.0, "end_logit": 2.0, "probability": 0.75}, {"text": "", "start_logit": 0.5, "end_logit": 0.0, "probability": 0.25}]}
    (tmp_path / "n.json").write_text(json.dumps(entries, indent=4))
    rows = readers.read_nbest(spark, str(tmp_path / "n.json")).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.text, r.probability) for r in rows] == [("q", 1, "a", 0.75), ("q", 2, "", 0.25)]
    corpus = {"7": {"text": "가\\n나 \n 다", "title": "t", "document_id": 3, "html": None}}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1, ensure_ascii=False))
    row = readers.read_corpus(spark, str(tmp_path / "c.json")).first()
    assert (row.doc_id, row.text, row.title, row.document_id) == (7, "가\\n나 \n 다", "t", 3)


def test_nested_questions(spark, tmp_path):
    nested = {"data": [{"title": "T", "paragraphs": [{"context": "c1", "qas": [
        {"id": "1", "question": "q1", "answers": [{"text": "a", "answer_start": 0}, {"text": "b", "answer_start": 4}]},
        {"id": "2", "question": "q2", "answers": []}]}]}]}
    (tmp_path / "n.json").write_text(json.dumps(nested, indent=2))
    rows = {r.id: r for r in readers.read_nested_qa(spark, str(tmp_path / "n.json")).collect()}
    assert rows["1"].answers.text == ["a", "b"] and rows["1"].answers.answer_start == [0, 4]
    assert rows["2"].title == "T" and rows["2"].answers.text == []


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n 둘\n")
    (tmp_path / "b.csv").write_text('first,text\nx,"two, three"\n')
    (tmp_path / "c.json").write_text('{"body": "four"}\n{"body": "five"}\n')
    read = lambda name: sorted(r.text for r in readers.read_text(spark, str(tmp_path / name)).collect())
    assert read("a.txt") == ["", " 둘", "one"] and read("b.csv") == ["two, three"] and read("c.json") == ["five", "four"]
    with pytest.raises(ValueError):
        readers.read_text(spark, str(tmp_path / "d.xml"))


def test_csv_rows(spark, tmp_path):
    rows = {**TRICKY, "e": "", "s": " lead and trail ", "n": None, "m": "\\N ", "q": '"', "c": "a,b\nc"}
    path = writers.write_csv(answers(spark, rows), str(tmp_path / "out"))
    assert {r.id: r.text for r in readers.read_rows(spark, path, "id string, text string").collect()} == rows


def test_cleaned_and_null_odds(spark, tmp_path):
    df = answers(spark, {"1": "《가》  '나'"}).withColumn("score_diff", F.lit(1.5))
    assert readers.read_predictions(spark, writers.write_cleaned(df, str(tmp_path)), whole_file=False).first().text == "가 나"
    path = writers.write_null_odds(df, str(tmp_path), "x")
    assert readers.read_predictions(spark, path, whole_file=False).first().text == "1.5"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_dir(spark, "x") != new_dir(spark, "x")

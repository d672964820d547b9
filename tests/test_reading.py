import hashlib
import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import pattern_spans
from lectern.operators import corpus as co
from lectern.operators import prepare, spans
from lectern.plans import reading

ANSWERS = "answers struct<answer_start:array<int>,text:array<string>>"


def example(i, n, answer=None, question="무엇 인가"):
    words = [f"가{j}" if j % 3 else "😀" for j in range(n)]
    text = " ".join(words)
    if answer is None:
        return (i, question, text, ([], []))
    begin = len(" ".join(words[: answer[0]])) + (1 if answer[0] else 0)
    return (i, question, text, ([begin], [" ".join(words[answer[0] : answer[1]])]))


EXAMPLES = [
    example(0, 50, (0, 1)), example(1, 50, (49, 50)), example(2, 50, (9, 12)), example(3, 50), example(4, 1, (0, 1)),
    example(5, 10, (3, 5)), example(6, 11, (3, 5)), (7, "q q", "", ([], [])),
]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(EXAMPLES, f"id long, question string, context string, {ANSWERS}")


def test_windows_cover_every_token_and_share_the_stride(examples):
    chunks = prepare.chunk_windows(examples, max_length=15, stride=4).collect()
    for i, _, text, _ in EXAMPLES:
        mine = sorted((c for c in chunks if c.id == i), key=lambda c: c.chunk)
        words = text.split(" ")
        capacity = 15 - 2 - 3
        assert [c.token_start for c in mine] == [k * (capacity - 4) for k in range(len(mine))]
        assert mine[-1].token_start + len(mine[-1].tokens) == len(words)
        assert all(c.token_start + len(c.tokens) < len(words) for c in mine[:-1])
        for c in mine:
            assert c.tokens == words[c.token_start : c.token_start + capacity] and c.context_start == 4
            assert [text[o.s : o.e] for o in c.offsets] == c.tokens


def test_a_question_that_fills_the_window_is_set_apart(spark):
    rows = [(1, "q q", "a b c"), (2, "q " * 20, "a b c")]
    df = spark.createDataFrame(rows, "id long, question string, context string")
    assert [r.id for r in prepare.too_long(df, max_length=15, stride=4).collect()] == [2]
    assert {r.id for r in prepare.chunk_windows(df, max_length=15, stride=4).collect()} == {1}


def test_answers_with_a_tokenizer_that_drops_characters(spark):
    context = "ab  cd, ef"
    df = spark.createDataFrame([(1, "q", context, ([8], ["ef"]))], f"id long, question string, context string, {ANSWERS}")
    (row,) = prepare.align_answer(prepare.chunk_windows(df, tokenizer=pattern_spans("[^ ,]+"))).collect()
    assert row.tokens == ["ab", "cd", "ef"] and row.start_position == row.end_position == row.context_start + 2


def test_slices_of_string_keys(spark):
    names = [f"k{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "id string")
    first = co.percent_slice(df, "id", 10).where("split = 'validation'").orderBy("id").collect()
    assert [r.id for r in first] == names[:10]


def test_answer_positions(examples):
    chunks = prepare.align_answer(prepare.chunk_windows(examples, max_length=15, stride=4)).collect()
    texts = {e[0]: e for e in EXAMPLES}
    for c in chunks:
        _, _, text, (starts, answers) = texts[c.id]
        inside = False
        if starts and c.offsets:
            lo, hi = starts[0], starts[0] + len(answers[0])
            inside = c.offsets[0].s <= lo and c.offsets[-1].e >= hi
        if not inside:
            assert (c.start_position, c.end_position) == (0, 0)
        else:
            a, b = c.offsets[c.start_position - c.context_start], c.offsets[c.end_position - c.context_start]
            assert text[a.s : b.e] == answers[0]
    assert any(c.start_position for c in chunks if c.id == 1)


def test_offsets_are_null_outside_the_context(examples):
    for f in prepare.inference_features(prepare.chunk_windows(examples, max_length=15, stride=4), 15).collect():
        known = [p for p, o in enumerate(f.offset_mapping) if o is not None]
        assert len(f.offset_mapping) == 15 and known == list(range(4, 4 + len(known)))


def scored(examples):
    def logits(df):
        score = lambda a: F.transform("offset_mapping", lambda o, p: ((F.col("id") * 5 + F.col("chunk") * 3 + p * a) % 7).cast("float"))
        return df.withColumn("start_logits", score(2)).withColumn("end_logits", score(3))

    chunks = prepare.chunk_windows(examples, max_length=15, stride=4)
    return logits(prepare.inference_features(chunks, 15))


def expected(example, features, n, longest, with_null):
    found, null = [], None
    for f in sorted(features, key=lambda f: f.chunk):
        order = lambda x: sorted(range(len(x)), key=lambda p: (-x[p], -p))[:n]
        base = f.start_logits[0] + f.end_logits[0]
        if null is None or base < null[0]:
            null = (base, f.start_logits[0], f.end_logits[0], (0, 0))
        for a, b in product(order(f.start_logits), order(f.end_logits)):
            o = f.offset_mapping
            if o[a] and o[b] and a <= b < a + longest:
                found.append((f.start_logits[a] + f.end_logits[b], f.start_logits[a], f.end_logits[b], (o[a].s, o[b].e)))
    if with_null and null:
        found.append(null)
    found = sorted(found, key=lambda x: -x[0])[:n]
    if with_null and null and (0, 0) not in [x[3] for x in found]:
        found.append(null)
    out = [(example[2][x[3][0] : x[3][1]], x[1], x[2], x[0]) for x in found]
    if not out or (len(out) == 1 and out[0][0] == ""):
        out.insert(0, ("empty", 0.0, 0.0, 0.0))
    total = sum(math.exp(x[3]) for x in out)
    return [(*x[:3], round(math.exp(x[3]) / total, 9)) for x in out], null


@pytest.mark.parametrize("with_null", [False, True])
def test_nbest(examples, with_null):
    features = scored(examples)
    rows = features.collect()
    got = {r.id: r for r in spans.predictions(examples, features, 5, 4, with_null).collect()}
    for e in EXAMPLES:
        want, null = expected(e, [f for f in rows if f.id == e[0]], 5, 4, with_null)
        assert [(x.text, x.start_logit, x.end_logit, round(x.probability, 9)) for x in got[e[0]].nbest] == want
        assert math.isclose(sum(x.probability for x in got[e[0]].nbest), 1.0)
        if with_null:
            assert got[e[0]].null_score == null[0]


def test_best_answers(examples):
    features = scored(examples)
    plain = spans.predictions(examples, features, 5, 4)
    assert {r.id: r.text for r in spans.best_answer(plain).collect()} == {r.id: r.nbest[0].text for r in plain.collect()}
    nulls = spans.predictions(examples, features, 5, 4, True)
    lists = {r.id: r for r in nulls.collect()}
    for r in spans.best_answer(nulls, True, threshold=0.5).collect():
        first = next(x for x in lists[r.id].nbest if x.text)
        diff = lists[r.id].null_score - first.start_logit - first.end_logit
        assert r.score_diff == diff and r.text == ("" if diff > 0.5 else first.text)


def test_example_without_features_answers_empty(spark, examples):
    none = scored(examples).where("false")
    assert {r.text for r in spans.best_answer(spans.predictions(examples, none)).collect()} == {"empty"}


def test_max_context_filter(examples):
    features = scored(examples).withColumn("best_here", F.transform("offset_mapping", lambda o, p: p == 6))
    rows = spans.span_pairs(features, max_context="best_here").collect()
    assert rows and {r.start_pos for r in rows} == {6}


def test_null_score(examples):
    features = scored(examples)
    want = {}
    for f in features.collect():
        want[f.id] = min(want.get(f.id, 99), f.start_logits[0] + f.end_logits[0])
    assert {r.id: r.null_score for r in spans.null_score(features).collect()} == want


def test_context_to_answer(examples):
    def reader(features):
        p = lambda at: F.transform("offset_mapping", lambda o, p: F.when(p == at, 1.0).otherwise(0.0))
        return features.withColumn("start_logits", p(5)).withColumn("end_logits", p(5))

    inputs = examples.select("context", "id", "question").where("id = 0")
    answers = reading.answer_questions(inputs, reader, 15, 4, n=20, max_answer_length=1).collect()
    words = EXAMPLES[0][2].split(" ")
    assert [a.text for a in answers] == [words[1]]


def test_pack_blocks(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(f"w{i}.{j}" for j in range(rng.randint(1, 9)))) for i in range(23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.batch, r.block_id): r.tokens for r in prepare.pack_blocks(df, block=6, batch=10).collect()}
    want = {}
    for b in range(3):
        tokens = [t for _, text in rows[b * 10 : b * 10 + 10] for t in text.split(" ")]
        usable = len(tokens) // 6 * 6 if len(tokens) >= 6 else len(tokens)
        for k in range(0, usable, 6):
            want[b, k // 6] = tokens[k : k + 6]
    assert got == want
    short = prepare.pack_blocks(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), block=50).collect()
    assert [r.tokens for r in short] == [["a", "b", "c"]]


def test_masking(spark):
    df = spark.createDataFrame([(i, list(range(100, 600))) for i in range(20)], "doc_id long, input_ids array<int>")
    rows = prepare.mask_tokens(df).orderBy("doc_id").collect()
    again = prepare.mask_tokens(df.repartition(7)).orderBy("doc_id").collect()
    assert rows == again
    chosen = [(p, x, y) for r in rows for p, (x, y) in enumerate(zip(r.input_ids, r.labels)) if y != -100]
    assert all(y == 100 + p for p, _, y in chosen)
    assert all(x == 100 + p for r in rows for p, (x, y) in enumerate(zip(r.input_ids, r.labels)) if y == -100)
    share = len(chosen) / 10000
    masked = sum(x == 4 for _, x, _ in chosen) / len(chosen)
    same = sum(x == y for _, x, y in chosen) / len(chosen)
    assert 0.13 < share < 0.17 and 0.75 < masked < 0.85 and 0.07 < same < 0.13


def test_training_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(103)], "id long")
    rows = prepare.training_batches(df, 10).collect()
    key = lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16), i)
    order = sorted(range(103), key=key)
    assert {r.id: r.batch for r in rows} == {i: n // 10 for n, i in enumerate(order) if n < 100}
    assert prepare.training_batches(df, 10, drop_last=False).count() == 103


def test_mlm_lines(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " \t"), (3, ""), (4, "가 나")], "i int, text string")
    assert [r.tokens for r in prepare.mlm_lines(df, 2).orderBy("i").collect()] == [["a", "b"], ["가", "나"]]


def test_slices_and_splits(spark):
    df = spark.createDataFrame([(i * 2, f"t{i % 40}") for i in range(205)], "doc_id long, text string").repartition(5)
    first = [r.doc_id for r in co.percent_slice(df, percent=5).where("split = 'validation'").orderBy("doc_id").collect()]
    assert first == [i * 2 for i in range(10)]
    assert co.percent_slice(df, percent=0).where("split = 'validation'").count() == 0
    train, validation = co.train_test_split(df, "doc_id", 0.3)
    assert train.count() + validation.count() == 205 and train.join(validation, "doc_id").count() == 0 and validation.count() > 30
    assert [r.doc_id for r in co.take_first(df, 3).collect()] == [0, 2, 4]
    assert {r.text: r.doc_id for r in co.dedup_corpus(df).collect()} == {f"t{i}": i * 2 for i in range(40)}


def test_columns_by_name_or_position(spark):
    df = spark.createDataFrame([("q", "c", "x")], "a string, context string, b string")
    assert co.resolve_columns(df, ["question", "context", "answers"]) == {"question": "a", "context": "context", "answers": "b"}
    assert co.select_roles(df, ["question", "context"]).columns == ["question", "context"]
    both = co.concat(df, spark.createDataFrame([("z",)], "b string"))
    assert [tuple(r) for r in both.orderBy("b").collect()] == [("q", "c", "x"), (None, None, "z")]

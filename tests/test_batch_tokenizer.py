"""Tokenizers on Arrow batches in every place that takes a tokenizer."""

import random
import re

import pytest

from lectern.functions.batch import batch_spans, batch_tokens
from lectern.functions.text import pattern_spans
from lectern.operators import prepare, sparse, tfidf
from lectern.sources import index as stored

PATTERN = r"[가-힣]{1,2}|[^\s가-힣]"
TEXTS = ["한국어 문장은 😀 이렇게 둘씩 나뉜다", "😀😀 서울 is big", "", "   ", None, "서울 서울 부산 😀"]


def loader(pattern):
    def load():
        word = re.compile(pattern)
        return lambda texts: [[m.span() for m in word.finditer(t)] for t in texts]

    return load


spans, tokens = batch_spans(loader(PATTERN), "syllables"), batch_tokens(loader(PATTERN), "syllables")


@pytest.fixture(scope="module")
def examples(spark):
    rng = random.Random(2)
    rows = []
    for i in range(12):
        context = " ".join(rng.choices([t for t in TEXTS if t], k=rng.randint(1, 12)))
        found = [m.span() for m in re.finditer(PATTERN, context)]
        s, e = rng.choice(found)
        rows.append((i, "부산 어디 😀", context, ([s], [context[s:e]]) if i % 3 else ([], [])))
    return spark.createDataFrame(rows, "id long, question string, context string, answers struct<answer_start:array<int>,text:array<string>>")


def test_offsets_are_characters(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    got = {r.text: r.t for r in df.select("text", spans(df["text"]).alias("t")).collect()}
    for text in TEXTS:
        expected = None if text is None else [(m.group(), *m.span()) for m in re.finditer(PATTERN, text)]
        assert (got[text] if text is None else [tuple(x) for x in got[text]]) == expected
    bare = {r.text: r.t for r in df.select("text", tokens(df["text"]).alias("t")).collect()}
    assert all(bare[t] == (None if t is None else re.findall(PATTERN, t)) for t in TEXTS)


def test_windows_answers_and_features(examples):
    options = {"max_length": 20, "stride": 3}
    column = pattern_spans(PATTERN.replace("\\s", " \\n"))
    results = []
    for tokenizer in (spans, column):
        chunks = prepare.chunk_windows(examples, tokenizer=tokenizer, **options)
        aligned = prepare.align_answer(chunks).drop("answers").orderBy("id", "chunk").collect()
        features = prepare.inference_features(chunks, 20).orderBy("id", "chunk").collect()
        results.append((aligned, features, prepare.too_long(examples, 10, 3, tokenizer=tokenizer).count()))
    assert results[0] == results[1] and len(results[0][0]) > 12
    rows = {r.id: r for r in examples.collect()}
    held = 0
    for r in results[0][0]:
        if r.start_position:
            part = r.offsets[r.start_position - r.context_start], r.offsets[r.end_position - r.context_start]
            held += rows[r.id].context[part[0].s : part[1].e] == rows[r.id].answers.text[0]
    assert held >= 8
    lines = prepare.mlm_lines(examples.selectExpr("id", "context AS text"), tokenizer=tokens).collect()
    assert all(r.tokens == re.findall(PATTERN, rows[r.id].context) for r in lines)


def test_sparse_indexes_and_their_paths(spark, examples, tmp_path):
    corpus = examples.selectExpr("id AS doc_id", "context AS text")
    questions = examples.selectExpr("id AS qid", "question")
    column = lambda text: sparse.F.regexp_extract_all(text, sparse.F.lit(f"({PATTERN})"), 1)
    hits = lambda t: sparse.bm25_topk(questions, sparse.bm25_index(corpus, t), 3, t).orderBy("qid", "rank").collect()
    assert hits(tokens) == hits(column) != []
    model = tfidf.tfidf_fit(corpus, 50, tokens)
    assert model.terms == tfidf.tfidf_fit(corpus, 50, column).terms
    index = stored.bm25_store(spark, str(tmp_path), corpus, tokenizer=tokens, buckets=2)
    assert index.terms.count() > 0 and any("syllables" in p.name for p in tmp_path.iterdir())

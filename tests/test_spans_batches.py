"""Answer spans are worked out for whole batches of features, not value by value."""

import math

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lectern.functions import offsets
from lectern.operators import prepare, spans
from lectern.session import BATCH_SETTING, SMALL_BATCH, small_batches


def order(logits, n):
    """Positions as Spark sorts them: NaN is largest, null smallest, the later position wins a tie."""
    key = lambda p: ((0, 0.0) if logits[p] is None else (2, 0.0) if math.isnan(logits[p]) else (1, logits[p]), p)
    return sorted(range(len(logits)), key=key, reverse=True)[:n]


ROWS = [
    (1, 0, [(0, 1), None, (2, 3), (4, 5)], [1.0, 9.0, 1.0, 3.0], [0.0, 9.0, 5.0, -0.0]),
    (1, 1, [(6, 7), (8, 9)], [math.nan, None, 2.0, math.inf], [1.0, math.nan]),
    (2, 0, None, [1.0], [1.0]),
    (3, 0, [(0, 1)], None, [1.0]),
    (None, 0, [(0, 1), (2, 3)], [None, None], [0.0, 1.0]),
]
SCHEMA = "id long, chunk long, offset_mapping array<struct<s:int,e:int>>, start_logits array<double>, end_logits array<double>"


@pytest.mark.parametrize("at_once", [1, 1 << 21])
def test_pairs_of_uneven_features(spark, monkeypatch, at_once):
    monkeypatch.setattr(spans, "NUMBERS_AT_ONCE", at_once)
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    out = spans.span_pairs(df, n=3, max_answer_length=2)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan
    want = set()
    for i, chunk, mapping, start, end in ROWS:
        known = lambda p: mapping is not None and p < len(mapping) and mapping[p] is not None  # noqa: B023, E731
        for a, s in enumerate(order(start, 3) if start else []):
            want |= {(i, chunk, a, b, s, e) for b, e in enumerate(order(end, 3)) if 0 <= e - s < 2 and known(s) and known(e)}
    got = {(r.id, r.chunk, r.start_rank, r.end_rank, r.start_pos, r.end_pos) for r in out.collect()}
    assert got == want and len(want) > 4
    assert all(r.score is None for r in out.where("id IS NULL").collect())
    best = spans.span_pairs(df, n=3, max_answer_length=2, keep=1).where("id = 1 AND chunk = 0").collect()
    assert [(r.score, r.s, r.e) for r in best] == [(6.0, 2, 3)]


def test_ranges_of_features_are_bounded_and_lose_none(monkeypatch):
    monkeypatch.setattr(spans, "NUMBERS_AT_ONCE", 40)
    lists = pa.array([[0.0] * n for n in (10, 10, 10, 90, 1, 1, 0)])
    parts = list(spans._slices(pa.RecordBatch.from_pydict({"start_logits": lists, "end_logits": lists}), 3))
    assert [x for a, b in parts for x in range(a, b)] == list(range(7))
    assert all(b - a == 1 or (b - a) * 10 <= 40 for a, b in parts)


def test_order_of_numbers():
    values = [None, -math.inf, -1.0, -0.0, 0.0, 2.0, math.inf, math.nan]
    keys = spans._ordered(pa.array(values, pa.float64(), from_pandas=False))
    assert (np.diff(keys) >= 0).all() and keys[3] == keys[4] and len(set(keys)) == 7


def test_parts_of_a_batch_have_their_own_values(monkeypatch):
    monkeypatch.setattr(spans, "NUMBERS_AT_ONCE", 20)
    lists = pa.array([[float(i)] * 10 for i in range(6)] + [None])
    parts = list(spans._parts(pa.RecordBatch.from_pydict({"start_logits": lists, "end_logits": lists, "id": pa.array(range(7))}), 3))
    assert [i for p in parts for i in p.column("id").to_pylist()] == [*range(6)]
    assert max(len(p.column("start_logits").values) for p in parts) <= 20


def test_tokens_of_a_batch_come_some_texts_at_a_time(monkeypatch):
    texts = pa.array(["a b", None, "c  d", "", "e f g"])
    whole = offsets.space_spans(texts)
    monkeypatch.setattr(offsets, "BYTES_AT_ONCE", 4)
    parts = list(offsets.space_span_parts(texts))
    assert len(parts) > 2 and pa.concat_arrays(parts).to_pylist() == whole.to_pylist()


EXAMPLES = [(1, "q", "a bb ccc d " * 150), (2, "w " * 300, "x y"), (3, None, "x y"), (4, "q", None), (None, "q", "one two"), (5, "q", "")]


@pytest.fixture
def examples(spark):
    return spark.createDataFrame(EXAMPLES, "id long, question string, context string").coalesce(1)


def test_every_step_in_python_runs_once(spark, examples):
    """Each of them is one more Python worker per task, so a filter must not bring a second one."""
    features = entry._reader(prepare.inference_features(prepare.chunk_windows(examples)))
    plan = spans.predictions(examples, features)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("MapInArrow") == 1


def test_scored_windows_do_not_depend_on_how_many_are_scored_at_a_time(spark, examples, monkeypatch):
    def scored():
        rows = entry._reader(prepare.inference_features(prepare.chunk_windows(examples))).collect()
        return {(r.id, r.chunk): (r.offset_mapping, r.start_logits, r.end_logits) for r in rows}

    whole = scored()
    # a question without room and a null one have no window
    assert {i for i, _ in whole} == {1, 4, 5, None} and sum(i == 1 for i, _ in whole) == 2
    monkeypatch.setattr(entry, "FEATURES_AT_ONCE", 2)
    assert scored() == whole
    mapping, start, end = whole[1, 1]
    width = lambda p: mapping[p].e - mapping[p].s if mapping[p] else 0
    assert start == [(31 + 17 + p * 7919 + width(p) * 613) % 997 / 100 for p in range(384)]
    assert end == [(37 + 17 + p * 6007 + width(p) * 613) % 997 / 100 for p in range(384)]


def test_a_session_with_small_batches(spark):
    def largest(session):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

        rows = session.range(3000, numPartitions=1).selectExpr("repeat('x', 4000) AS v")
        return max(r.bytes for r in rows.mapInArrow(sizes, "bytes long").collect())

    own, before = small_batches(spark), spark.conf.get(BATCH_SETTING)
    assert largest(spark) > 2 * SMALL_BATCH > largest(own) and spark.conf.get(BATCH_SETTING) == before
    assert own.conf.get("spark.checkpoint.dir") == spark.conf.get("spark.checkpoint.dir")
    own.conf.set(BATCH_SETTING, "1m")
    assert small_batches(own).conf.get(BATCH_SETTING) == str(1 << 20)


@pytest.mark.parametrize("name", ["best_answer", "best_answer_null", "nbest_softmax", "span_nbest", "span_pairs"])
def test_answers_are_worked_out_in_small_batches(spark, tmp_path, name):
    docs = [(i, "one two three " * i, "en", "web") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = entry.queries()[name](spark, str(tmp_path))
    assert int(out.sparkSession.conf.get(BATCH_SETTING)) <= SMALL_BATCH
    assert out.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")

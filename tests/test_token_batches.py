"""Tokens and their offsets are found for whole batches, not value by value."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import offsets, text

TEXTS = ["", None, "a", " ", "가나 다  라", None, "ab 😀 é", "x " * 30 + "y"]


@pytest.mark.parametrize("at_once", [1, 9, 1 << 22])
def test_space_spans_of_a_batch(monkeypatch, at_once):
    monkeypatch.setattr(offsets, "BYTES_AT_ONCE", at_once)
    got = offsets.space_spans(pa.array(["cut off", *TEXTS]).slice(1)).to_pylist()
    assert [g and [x["token"] for x in g] for g in got] == [t if t is None else t.split(" ") for t in TEXTS]
    assert all(t[x["s"] : x["e"]] == x["token"] for t, g in zip(TEXTS, got) if g for x in g)
    assert offsets.space_spans(pa.array([], pa.string())).to_pylist() == []


def test_spans_after_gaps_of_a_batch():
    tokens = pa.array([["x"], ["가", "bc"], None, [], ["é"]], pa.list_(pa.string())).slice(1)
    gaps = pa.array([[9, 9], [2, 1, 7], None, [3], [0, 0]], pa.list_(pa.int32())).slice(1)
    got = offsets.spans_after_gaps(tokens, gaps).to_pylist()
    places = [g if g is None else [(x["token"], x["s"], x["e"]) for x in g] for g in got]
    assert places == [[("가", 2, 3), ("bc", 4, 6)], None, [], [("é", 0, 1)]]


def test_tokenizers_make_no_sum_per_token(spark):
    df = spark.createDataFrame([("a b, c",)], "t string")
    for tokenizer in (text.space_spans, text.pattern_spans("[^ ,]+")):
        made = df.select(tokenizer(F.col("t")).alias("x"))
        assert "aggregate(" not in made._jdf.queryExecution().toString()
        assert made.first().x[-1].e == 6

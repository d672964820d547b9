import random
from itertools import accumulate
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import arrays, text
from lectern.functions.vectors import dot, l2_normalize, squared_l2

TEXTS = ["", "a", " ", "가나 다라  가나", "ab 😀 ab 😀x", "one\ntwo three", "x " * 300 + "y"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expr):
    return [r[1] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_answer_cleanup(spark):
    values = ["《책》 '이름'", "  a　b\t<c> ", "「x」〈y〉‘z’", '"q"', "≪남김≫ (괄호)"]
    want = ["책 이름", "a b c", "x y z", "q", "≪남김≫ (괄호)"]
    assert evaluate(column(spark, values), text.normalize_answer(F.col("v"))) == want


def test_breaks_keep_the_letter_n(spark):
    values = ["an\nb \\n c", "n|+n", "  \n "]
    df = column(spark, values)
    assert evaluate(df, text.normalize_ws(F.col("v"))) == ["an b c", "n|+n", " "]
    assert evaluate(df, text.compact_key(F.col("v"))) == ["anbc", "n|+n", ""]


def test_blank_lines(spark):
    values = ["", " \t　", "x", " 가 "]
    assert evaluate(column(spark, values), text.is_blank(F.col("v"))) == [True, True, False, False]


def squad(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_squad_normaliser(spark):
    values = ["The cat, an Owl!", "theatre a", "", "그 the 책", "a.b the_end an", "the"]
    assert evaluate(column(spark, values), text.squad_normalize(F.col("v"))) == [squad(v) for v in values]


def test_space_tokens_keep_empty_tokens(spark):
    assert evaluate(column(spark, TEXTS), text.space_tokens(F.col("v"))) == [t.split(" ") for t in TEXTS]


def test_ngrams(spark):
    def want(t):
        t = t.split(" ")
        return t + [f"{x} {y}" for x, y in zip(t, t[1:])]

    assert evaluate(column(spark, TEXTS), text.ngrams(text.space_tokens(F.col("v")), 1, 2)) == [want(t) for t in TEXTS]


def test_token_spans_cut_the_text_at_its_tokens(spark):
    rng = random.Random(1)
    long = " ".join("가b😀"[: rng.randint(0, 3)] for _ in range(1000))
    values = [*TEXTS, long]
    for value, spans in zip(values, evaluate(column(spark, values), text.space_spans(F.col("v")))):
        assert [value[s.s : s.e] for s in spans] == value.split(" ") == [s.token for s in spans]


def test_pattern_spans_assume_nothing_between_tokens(spark):
    values = ["ab  cd, ef", "", "  ", "한국어 문장, 둘! 😀😀 ok", ",,x,,", "a" * 300 + "  \n b"]
    for value, spans in zip(values, evaluate(column(spark, values), text.word_spans(F.col("v")))):
        assert [value[s.s : s.e] for s in spans] == [s.token for s in spans] and "".join(s.token for s in spans) == "".join(value.split())
    cut = text.pattern_spans("[^ ,]+")
    for value, spans in zip(values, evaluate(column(spark, values), cut(F.col("v")))):
        assert [value[s.s : s.e] for s in spans] == [s.token for s in spans] == [t for t in value.replace(",", " ").split(" ") if t]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 4096, 4097, 9000])
def test_running_ends(spark, n):
    values = list(range(n))
    want = list(accumulate(values))
    assert evaluate(column(spark, [values], "array<int>"), arrays.running_ends(F.col("v"))) == [want]


def test_value_counts(spark):
    got = evaluate(column(spark, TEXTS), arrays.value_counts(text.space_tokens(F.col("v"))))
    assert [dict((x.term, x.tf) for x in row) for row in got] == [dict(Counter(t.split(" "))) for t in TEXTS]


def test_multiset_overlap(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"], ["a", "a", "a", "c"]), (1, [], ["x"])], "i int, v array<string>, w array<string>")
    assert evaluate(df, arrays.multiset_overlap(F.col("v"), F.col("w"))) == [2, 0]


def test_pad_truncate(spark):
    got = evaluate(column(spark, [[1, 2], [1, 2, 3, 4], []], "array<int>"), text.pad_truncate(F.col("v"), 3, F.lit(0)))
    assert [(r.input_ids, r.attention_mask) for r in got] == [([1, 2, 0], [1, 1, 0]), ([1, 2, 3], [1, 1, 1]), ([0, 0, 0], [0, 0, 0])]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0], [1.0, 0.0]), (1, [0.0, 0.0], [1.0, 2.0])], "i int, v array<float>, w array<float>")
    assert evaluate(df, dot(F.col("v"), F.col("w"))) == [3.0, 0.0]
    assert evaluate(df, squared_l2(F.col("v"), F.col("w"))) == [20.0, 5.0]
    assert evaluate(df, l2_normalize(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0]]


def test_scratch_goes_when_it_is_cleared(spark):
    from pathlib import Path

    from lectern.session import clear_scratch, materialized

    clear_scratch(spark)
    df = materialized(spark.range(5), "few")
    path = Path(df.inputFiles()[0].replace("file:", "")).parent
    assert df.count() == 5 and path.exists()
    assert clear_scratch(spark) == 1 and not path.exists()

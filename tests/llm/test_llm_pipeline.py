"""The pipeline and the registered queries on the small tables."""

import hashlib
import os

import pytest

import corpus_pipeline
from lectern.llm import queries, statements

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the small tables")


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(statements.statements()) <= set(names)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_one_row_per_input_row(spark, name):
    table = "pages" if name.split("_")[0] in ("op7", "op10") else "documents"
    out = queries.queries()[name](spark, DIR)
    assert out.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialized(stage(spark, docs, DIR), name)
        if name != "tokens":
            assert docs.dtypes == before.dtypes
    assert [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_run_equals_stages_on_an_empty_table(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_51_words_are_cut(spark):
    def words(stem, n):
        return " ".join(f"{stem}{k}" for k in range(n))

    # the shortest passages there can be, common ones, and one of a word too few (more than 101 bytes)
    tiny = " ".join("abcdefghijklmnopqrstuvwxyz"[k * k % 26] if k % 3 else str(k % 10) for k in range(51))
    usual, short = words("word", 51), words("longer-word", 50)
    assert len(tiny) == 101 and len(usual) < 400 and len(short) > 400
    texts = {}
    for i, passage in enumerate((tiny, usual, short)):
        for j in range(2):
            texts[2 * i + j] = f"{words(f'before{i}x{j}y', 60)} {passage} {words(f'after{i}x{j}y', 60)}"
    texts[6] = texts[7] = words("same", 51)
    texts[8] = texts[9] = words("a-long-word-of-a-copy", 50)
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, DIR).collect()}
    assert set(got) == set(texts)
    for k in range(4):
        cut = got[k].text
        # spaces and the equal start of the neighbouring words go with the passage
        assert (tiny if k < 2 else usual) not in cut and cut.split()[:59] + cut.split()[-59:] == texts[k].split()[:59] + texts[k].split()[-59:]
    assert all(got[k].text == texts[k] for k in (4, 5, 8, 9)) and got[6].text == got[7].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())

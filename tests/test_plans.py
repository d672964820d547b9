"""What the physical plans must and must not hold."""

import pytest

import __spark_entry__ as entry
from lectern.operators import sparse
from lectern.operators.corpus import percent_slice
from lectern.sources import index as stored

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bm25_topk", "tfidf_topk", "dense_topk", "dense_topk_block", "span_nbest", "recall_at_k", "hard_negatives"])
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["bm25_topk", "tfidf_topk", "dense_topk", "span_nbest"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    before_shuffle = text.rindex("WindowGroupLimit")
    assert text.count("WindowGroupLimit") >= 2 and "hashpartitioning" in text[:before_shuffle]


def test_a_stored_question_reads_its_folders_only(spark, tmp_path):
    index = stored.bm25_store(spark, str(tmp_path), entry._corpus(spark, SF), buckets=16)
    text = plan(stored.bm25_search_stored(spark, "the and", index, 5))
    assert "PartitionFilters: [bucket" in text and "In(term" in text


def test_a_stored_vector_question_reads_its_cells_only(spark, tmp_path):
    vectors = entry._vectors(spark, SF, "doc_id").drop("label")
    centroids, cells = stored.ivf_store(spark, str(tmp_path), vectors, 8)
    asked = [float(x) for x in vectors.first()["embedding"]]
    found = stored.ivf_search_stored(spark, asked, centroids, cells, 5, 2)
    assert "PartitionFilters: [cluster_id" in plan(found) and found.count() == 5


def test_another_tokenizer_is_another_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "x y z")], "doc_id long, text string")
    upper = lambda text: entry.F.split(entry.F.upper(text), " ")
    plain = stored.bm25_store(spark, str(tmp_path), corpus, buckets=2)
    with pytest.raises(ValueError):
        stored.bm25_store(spark, str(tmp_path), corpus, buckets=2, tokenizer=upper)
    loud = stored.bm25_store(spark, str(tmp_path), corpus, buckets=2, tokenizer=upper, tokenizer_name="upper")
    assert {r.term for r in plain.terms.collect()} == {r.term.lower() for r in loud.terms.collect()} != {r.term for r in loud.terms.collect()}


def test_documents_are_scored_in_place(spark):
    for name in ("bm25_topk", "tfidf_topk"):
        text = plan(entry.queries()[name](spark, SF))
        assert "MapInArrow" in text and "hashpartitioning(qid" in text and "doc_id#" not in text.split("hashpartitioning(")[1].split(")")[0]


def test_scans_read_the_needed_columns(spark):
    text = plan(entry.token_counts(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_slicing_moves_keys_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(percent_slice(docs))
    main = text.split("Subquery")[0]
    assert "Exchange" not in main


def test_term_frequencies_need_no_shuffle(spark):
    docs = sparse.counted_terms(spark.read.parquet(f"{SF}/documents.parquet"), entry.tx.space_tokens(entry.F.col("text")), "doc_id", "doc_id")
    assert "Exchange" not in plan(sparse.postings(docs))

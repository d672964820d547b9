"""Sparse scoring: BM25 and the shared sparse top-k.

Term counts come from each row's own token array, so building them needs no shuffle; only
document frequencies do, and they are pre-aggregated per task. A document's terms stay in
its row: questions go to the documents, and each task returns ``k`` hits per question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.arrays import rows_of, value_counts
from lectern.functions.text import Tokenizer, space_tokens
from lectern.operators.ranking import top_k
from lectern.session import materialized

# BM25 parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Question terms that tasks hold at a time; more questions are scored in several passes.
TERMS_PER_PASS = 1_000_000
# Scores held at a time by one task, and products of a question's and a document's term.
SCORES_AT_ONCE = 2_000_000
PRODUCTS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Bm25Index:
    """``docs(doc_id, dl, counts)``, ``terms(term, df, idf)`` and one-row ``stats``.

    A stored index also has ``buckets``: postings in folders by term hash.
    """

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: DataFrame | None = None
    n_buckets: int = 0


def counted_terms(df: DataFrame, tokens: Column, id_col: str, out_id: str) -> DataFrame:
    """One row per document: ``(out_id, dl, counts array<struct<term,tf>>)``."""
    return df.select(F.col(id_col).alias(out_id), tokens.alias("tokens")).select(
        out_id, F.size("tokens").cast("long").alias("dl"), value_counts(F.col("tokens")).alias("counts")
    )


def postings(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, dl, term, tf)``, one row per document and term."""
    return rows_of(docs, [id_col, "dl"], F.col("counts"), "c").select(id_col, "dl", "c.term", "c.tf")


def bm25_index(corpus: DataFrame, tokenizer: Tokenizer = space_tokens, doc_id: str = "doc_id", text: str = "text") -> Bm25Index:
    """Term counts, document frequencies and corpus statistics of a de-duplicated corpus.

    The counted documents and the frequencies are written once: statistics, weights and
    scoring all read them.
    """
    docs = materialized(counted_terms(corpus, tokenizer(F.col(text)), doc_id, "doc_id"), "bm25-docs")
    return bm25_from_counts(docs, materialized(document_frequency(docs), "bm25-df"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """``(term, df)``; reads the terms only."""
    return rows_of(docs, [], F.col("counts.term"), "term").groupBy("term").agg(F.count("*").alias("df"))


def bm25_from_counts(docs: DataFrame, frequency: DataFrame) -> Bm25Index:
    """The index of counted documents and their document frequencies."""
    sizes = docs.agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum(F.size("counts")).alias("n_postings")
    )
    n_docs = sizes.select("n_docs").scalar()
    raw = F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = frequency.withColumn("raw", raw)
    # The mean runs over the whole vocabulary, negative values included.
    average = weighted.agg(F.avg("raw")).scalar()
    terms = weighted.select("term", "df", F.when(F.col("raw") < 0, EPSILON * average).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(docs, terms, sizes)


def bm25_doc_weights(index: Bm25Index) -> DataFrame:
    """Hashed terms of each document with saturated, length-normalised weights, without idf: ``(doc_id, keys, weights)``."""
    normed = index.docs.withColumn("norm", K1 * (1 - B + B * F.col("dl") / index.stats.select("avgdl").scalar()))
    weights = F.transform("counts", lambda c: c["tf"] * (K1 + 1) / (c["tf"] + F.col("norm")))
    return normed.select("doc_id", F.transform("counts", lambda c: F.xxhash64(c["term"])).alias("keys"), weights.alias("weights"))


def saturated(rows: DataFrame, index: Bm25Index) -> DataFrame:
    """The weight of each posting ``(doc_id, dl, term, tf)``."""
    avgdl = index.stats.select("avgdl").scalar()
    norm = K1 * (1 - B + B * F.col("dl") / avgdl)
    return rows.select("doc_id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("dw"))


def bm25_question_weights(
    questions: DataFrame, index: Bm25Index, tokenizer: Tokenizer = space_tokens, qid: str = "qid", text: str = "question"
) -> DataFrame:
    """``(qid, term, qw)``: idf times the term's count in the question; unknown terms drop out."""
    counts = counted_terms(questions, tokenizer(F.col(text)), qid, "qid")
    return postings(counts, "qid").join(index.terms, "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("qw"))


def bm25_topk(
    questions: DataFrame,
    index: Bm25Index,
    k: int = 10,
    tokenizer: Tokenizer = space_tokens,
    qid: str = "qid",
    text: str = "question",
    terms_per_pass: int = TERMS_PER_PASS,
) -> DataFrame:
    """Best ``k`` documents per question, ``(qid, rank, doc_id, score)``."""
    weights = bm25_question_weights(questions, index, tokenizer, qid, text)
    keyed = weights.select("qid", F.xxhash64("term").alias("key"), "qw")
    return sparse_topk(keyed, bm25_doc_weights(index), k, terms_per_pass)


def bm25_search(spark: SparkSession, question: str, index: Bm25Index, k: int = 10, tokenizer: Tokenizer = space_tokens) -> DataFrame:
    """One question given as text."""
    one = spark.createDataFrame([(0, question)], "qid long, question string")
    return bm25_topk(one, index, k, tokenizer)


def bm25_top_n(questions: DataFrame, index: Bm25Index, corpus: DataFrame, n: int = 5, **options) -> DataFrame:
    """Hits with their passage texts."""
    return with_texts(bm25_topk(questions, index, n, **options), corpus)


def with_texts(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Join hits with their texts."""
    return corpus.select("doc_id", "text").join(hits, "doc_id")


def posting_topk(questions: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of one question's terms ``(qid, term, qw)`` over the postings ``(doc_id, term, dw)`` of these terms."""
    hits = postings.join(F.broadcast(questions), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))
    return top_k(hits, "qid", k).select("qid", "rank", "doc_id", "score")


def sparse_topk(questions: DataFrame, docs: DataFrame, k: int, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """Top ``k`` by sparse dot product of ``(qid, key, qw)`` and documents ``(doc_id, keys, weights)``.

    Documents are scored where they are: a task gets the questions' terms as arrays and
    returns ``k`` rows per question. Questions beyond ``terms_per_pass`` terms are dealt by
    hash into several passes over the documents. Documents without a common term are not
    returned. Scores are compared after rounding, ties go to the smaller id. Several passes
    read documents that are written once; the driver holds one pass's terms at a time, and its best
    hits are written before the next is loaded.
    """
    asked = materialized(questions.select("qid", "key", "qw"), "questions")
    passes, hits = -(-asked.count() // terms_per_pass), None
    if passes <= 1:
        return _ranked(_scan(_collected(asked), questions, docs, k)[0], k)
    docs = materialized(docs.select("doc_id", "keys", "weights"), "weights")
    for i in range(passes):
        found, shared = _scan(_collected(asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)), questions, docs, k)
        best = materialized(_ranked(found, k), "hits")
        shared.destroy()
        hits = best if hits is None else hits.union(best)
    return hits


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, "qid", k).select("qid", "rank", "doc_id", "score")


def _collected(asked: DataFrame) -> pd.DataFrame:
    """Terms of questions at the driver, as columns of numbers: an id is held once, not once a term."""
    table = asked.toArrow()
    ids = table.column("qid").combine_chunks().dictionary_encode()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    numbers = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    named = pd.Categorical.from_codes(numbers, pd.Index(ids.dictionary.to_pandas()))
    return pd.DataFrame({"qid": named, "key": table.column("key").to_numpy(), "qw": table.column("qw").to_numpy()})


class Questions:
    """The terms of some questions, sorted by term: for each key the questions that ask for it."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("key", kind="stable")
        number, ids = pd.factorize(rows["qid"])
        self.ids = np.asarray(ids)
        self.number, self.weights = number.astype(np.int64), rows["qw"].to_numpy(float)
        self.keys, starts = np.unique(rows["key"].to_numpy(np.int64), return_index=True)
        self.starts = np.append(starts, len(rows))

    def scores(self, keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``questions x n`` scores of documents given by their terms, and where a term was shared.

        A common term meets many questions, so products are made in slices.
        """
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        at, weights, owner = at[hit], weights[hit], owner[hit]
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        cells = len(self.ids) * n
        sums, shared, begin = np.zeros(cells), np.zeros(cells, bool), 0
        while begin < len(at):
            done = ends[begin] - counts[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, done + PRODUCTS_AT_ONCE, "right")))
            own = counts[begin:stop]
            row = np.repeat(np.arange(begin, stop), own)
            term = np.arange(len(row)) - np.repeat(ends[begin:stop] - own - done, own) + self.starts[at[row]]
            cell = self.number[term] * n + owner[row]
            sums += np.bincount(cell, self.weights[term] * weights[row], cells)
            shared[cell] = True
            begin = stop
        return sums.reshape(-1, n), shared.reshape(-1, n)


def _scan(asked: pd.DataFrame, questions: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The best ``k`` hits of every task, and the questions as sent to the tasks."""
    types = {name: df.schema[name].dataType.simpleString() for name, df in (("qid", questions), ("doc_id", docs))}
    shared = docs.sparkSession.sparkContext.broadcast(Questions(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = shared.value, None
        if not len(own.ids):
            return
        step = max(1, SCORES_AT_ONCE // len(own.ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                found = best_documents(own, batch.slice(at, step), k)
                best = found if best is None else _best(pd.concat([best, found]), k)
        if best is not None:
            out = pd.DataFrame({"qid": own.ids[best["q"]], "doc_id": best["doc_id"], "score": best["score"]})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    schema = f"qid {types['qid']}, doc_id {types['doc_id']}, score double"
    return docs.select("doc_id", "keys", "weights").mapInArrow(run, schema), shared


def best_documents(questions: Questions, docs: pa.RecordBatch, k: int) -> pd.DataFrame:
    """At most ``k`` of these documents per question: ``q`` (number of the question), ``doc_id``, ``score``."""
    ids = docs.column("doc_id").to_pandas()
    order = np.argsort(ids.to_numpy(), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    lists = docs.column("keys")
    owner = np.repeat(place, lists.value_lengths().fill_null(0).to_numpy())
    scores, shared = questions.scores(
        lists.flatten().to_numpy().astype(np.int64), docs.column("weights").flatten().to_numpy().astype(float), owner, len(ids)
    )
    # one whole number per cell: the rounded score, then the smaller id
    key = np.where(shared, np.rint(scores * 1e6) * 2.0**20 - np.arange(len(ids)), -np.inf)
    if len(ids) > k:
        columns = np.argpartition(-key, k - 1, axis=1)[:, :k]
    else:
        columns = np.broadcast_to(np.arange(len(ids)), key.shape)
    rows = np.broadcast_to(np.arange(len(key))[:, None], columns.shape)
    kept = shared[rows, columns]
    rows, columns = rows[kept], columns[kept]
    return pd.DataFrame({"q": rows, "doc_id": ids.to_numpy()[order][columns], "score": scores[rows, columns]})


def _best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    ranked = hits.assign(key=-hits["score"].round(6)).sort_values(["q", "key", "doc_id"])
    return ranked.groupby("q", sort=False).head(k).drop(columns="key")

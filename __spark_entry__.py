"""

Every query reads whole tables. Scores are rounded to four digits in the output; ranks
come from scores rounded to six, so summation order does not change a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from lectern.functions import text as tx
from lectern.functions.arrays import rows_of
from lectern.functions.batch import batch_spans
from lectern.functions.offsets import ends_of, list_of, places
from lectern.functions.vectors import as_double, dot, l2_normalize
from lectern.operators import corpus as co
from lectern.operators import dense, ensemble, fusion, ivf, lsa, metrics, prepare, profile, quantized, sparse, spans, tfidf
from lectern.operators.contain import containing
from lectern.operators.ranking import top_k
from lectern.plans import reading, retrieval
from lectern.session import materialized, new_dir, small_batches
from lectern.sources import index as stored
from lectern.sources import readers, writers

SMOKE_DIR = "/root/testdata/sf0.001"
# Tables whose rows take long to work on.
TEXT_TABLES = ("documents", "conversations", "pages")
LSA_COMPONENTS = 100
# Windows that are scored at a time.
FEATURES_AT_ONCE = 512
# Documents that bound a question's best scores from below: one of so many.
BOUND_SHARE = 64
QUESTION = "the of and Eauouon. thou oureadi der la de los"
MODELS = ("base", "partner", "challenger", "fourth", "fifth")


# --- inputs -----------------------------------------------------------------


def _load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.read_table(spark, f"{sf}/{name}.parquet", spread=name in TEXT_TABLES)


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return co.dedup_corpus(_load(spark, sf, "documents").select("doc_id", "text"))


def _corpus_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows written once, for queries that read the corpus several times."""
    return materialized(_corpus(spark, sf), "corpus")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _gold(spark: SparkSession, sf: str, corpus: DataFrame) -> DataFrame:
    """Pairs ``(qid, doc_id, question, text)`` where the passage contains the question text."""
    questions, texts = _questions(spark, sf), corpus.select("doc_id", "text")
    pairs = containing(questions, texts).join(questions, "qid").join(texts, "doc_id")
    return materialized(pairs.select("qid", "doc_id", "question", "text"), "gold")


def _vectors(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _load(spark, sf, "embeddings").select(F.col("vec_id").alias(name), "embedding", "label")


def _encoded(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return dense.encode(df, dense.hash_encoder(), text).select(id_col, "embedding")


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    e = _load(spark, sf, "embeddings").select("label", array_to_vector(as_double(F.col("embedding"))).alias("v"))
    means = e.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(F.col("label").alias("cluster_id"), vector_to_array("m").alias("centroid"))


def _cells(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    return materialized(ivf.ivf_assign(_vectors(spark, sf, "doc_id"), _centroids(spark, sf), metric), "cells")


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    """One question per document; labelled good documents have their middle word as answer."""
    docs = _load(spark, sf, "documents")
    good = _load(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    words = F.split("text", " ")
    middle = F.floor(F.size(words) / 2).cast("int")
    start = F.length(F.array_join(F.slice(words, F.lit(1), middle), " ")) + F.when(middle > 0, 1).otherwise(0)
    answer = F.struct(F.array(start.cast("int")).alias("answer_start"), F.array(F.get(words, middle)).alias("text"))
    nothing = F.struct(F.array().cast("array<int>").alias("answer_start"), F.array().cast("array<string>").alias("text"))
    return docs.join(good, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", "lang", "source").alias("question"),
        F.col("text").alias("context"),
        F.when(F.col("good"), answer).otherwise(nothing).alias("answers"),
    )


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.chunk_windows(_examples(spark, sf))


def _reader(features: DataFrame) -> DataFrame:
    """Scores that depend on the document, the window and the token's length."""

    def scored(ids: pa.Array, chunks: pa.Array, mapping: pa.Array) -> pa.Array:
        at, gone = ends_of(mapping), mapping.is_null()
        counts = np.where(gone.to_numpy(zero_copy_only=False), 0, np.diff(at))
        offsets = mapping.values.take(pa.array(places(at[:-1], counts)))
        width = pc.subtract(pc.struct_field(offsets, "e"), pc.struct_field(offsets, "s")).fill_null(0).to_numpy(zero_copy_only=False)
        row, p = pa.array(np.repeat(np.arange(len(mapping)), counts)), places(np.zeros(len(mapping), np.int64), counts)

        def logits(a: int, b: int) -> pa.Array:
            own = pc.add(pc.multiply(ids.cast(pa.int64()), a), pc.multiply(chunks.cast(pa.int64()), 17)).take(row)
            total = own.fill_null(0).to_numpy(zero_copy_only=False) + p * b + width.astype(np.int64) * 613
            return list_of(pa.array(np.fmod(total, 997) / 100.0, mask=own.is_null().to_numpy(zero_copy_only=False)), counts, gone)

        return pa.StructArray.from_arrays([logits(31, 7919), logits(37, 6007)], names=["start", "end"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for at in range(0, len(columns[0]), step):
                yield scored(*(c.slice(at, step) for c in columns))

    step = FEATURES_AT_ONCE
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    both = F.arrow_udf(run, "struct<start:array<double>,end:array<double>>")("id", "chunk", "offset_mapping")
    logits = [F.col(f"_logits.{side}").alias(f"{side}_logits") for side in ("start", "end")]
    return features.withColumn("_logits", both).select(*features.columns, *logits)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return _reader(prepare.inference_features(_chunks(spark, sf)))


def _predicted(spark: SparkSession, sf: str, with_null: bool = False) -> DataFrame:
    spark = small_batches(spark)
    return spans.predictions(_examples(spark, sf), _features(spark, sf), with_null=with_null)


def _nbest(spark: SparkSession, sf: str, model: str) -> DataFrame:
    """Ranked answers of one model: a quarter of each vector, the fifth model their mean."""
    e = as_double(F.col("embedding"))
    m = MODELS.index(model)
    if m < 4:
        values = F.slice(e, 16 * m + 1, 16)
    else:
        at = lambda j, part: F.element_at(e, j + 16 * part)
        values = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: (at(j, 0) + at(j, 1) + at(j, 2) + at(j, 3)) / 4)
    entries = F.transform(
        values,
        lambda x, i: F.struct(
            (-x).alias("cost"),
            F.concat(F.lit("a"), ((i + 1) % 3).cast("string")).alias("text"),
            (x * 20).alias("start_logit"),
            F.lit(0.0).alias("end_logit"),
            (x * 20).alias("score"),
        ),
    )
    table = _load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), spans.softmax(F.sort_array(entries)).alias("nbest"))
    return spans.span_nbest(table).drop("cost")


def _answers(spark: SparkSession, sf: str, model: str) -> DataFrame:
    return _nbest(spark, sf, model).where("rank = 1").select("id", "text")


def _confidence(spark: SparkSession, sf: str, model: str) -> DataFrame:
    return ensemble.max_probability(_nbest(spark, sf, model))


def _models(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.combined({m: _nbest(spark, sf, m) for m in MODELS})


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.ensemble_rules(_models(spark, sf), "base", "partner", "challenger")


def _turn_id() -> Column:
    return F.concat_ws("-", "conv_id", "turn")


def _answer_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as prediction; references are the decorated turn (user) and the next turn."""
    turns = _load(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    predicted = turns.select(_turn_id().alias("id"), F.col("text").alias("prediction_text"))
    decorated = F.when(F.col("role") == "user", F.concat(F.lit("The "), "text", F.lit("!"))).otherwise("none")
    references = turns.join(following, ["conv_id", "turn"], "left").select(
        _turn_id().alias("id"), F.array(decorated, F.coalesce("next", F.lit(""))).alias("texts")
    )
    return predicted, references


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


# --- sources and sinks --------------------------------------------------------


def read_corpus_json(spark, sf):
    """Documents written as JSON objects keyed by id, one object per line, and read back."""
    path = new_dir(spark, "corpus")
    docs = _corpus(spark, sf)
    value = F.struct("text", F.col("doc_id").alias("document_id"))
    docs.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), value)).alias("value")).write.text(path)
    back = readers.read_corpus(spark, path, whole_file=False)
    return back.select("doc_id", "document_id", F.md5("text").alias("text_md5"))


def read_text_lines(spark, sf):
    path = new_dir(spark, "lines") + ".txt"
    _load(spark, sf, "documents").select("text").write.text(path)
    lines = readers.read_text(spark, path)
    return lines.groupBy("text").agg(F.count("*").alias("n")).select(F.md5("text").alias("line_md5"), "n")


def flatten_nested_qa(spark, sf):
    turn = _load(spark, sf, "conversations")
    answer = F.array(F.struct(F.col("text"), F.lit(0).alias("answer_start")))
    qa = F.struct(_turn_id().alias("id"), F.col("role").alias("question"), answer.alias("answers"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    article = F.struct(F.col("conv_id").cast("string").alias("title"), F.array(paragraph).alias("paragraphs"))
    flat = readers.flatten_nested_qa(turn.select(F.array(article).alias("data")))
    return flat.select(
        "title", "id", "question", F.md5("context").alias("context_md5"),
        F.col("answers.answer_start")[0].cast("long").alias("answer_start"), F.md5(F.col("answers.text")[0]).alias("answer_md5"),
    )


def qa_roundtrip(spark, sf):
    path = new_dir(spark, "qa")
    examples = _examples(spark, sf).select(F.col("id").cast("string").alias("id"), "question", "context", "answers")
    train, validation = co.train_test_split(examples)
    writers.write_qa(train, path, "train")
    writers.write_qa(validation, path, "validation")
    back = [readers.read_qa(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "validation")]
    return co.concat(*back).select(
        "id", "split", "question", F.size("answers.text").cast("long").alias("n_answers"), F.md5("context").alias("context_md5")
    )


def predictions_from_json(spark, sf):
    path = writers.write_predictions(_answers(spark, sf, "base"), new_dir(spark, "predictions"))
    return readers.read_predictions(spark, path, whole_file=False)


def predictions_to_json(spark, sf):
    """Answer texts of the documents, with their quotes and line breaks, through a JSON file."""
    answers = reading.best_answer(_predicted(spark, sf))
    path = writers.write_predictions(answers, new_dir(spark, "answers"), writers.run_prefix(50000))
    return readers.read_predictions(spark, path, whole_file=False)


def nbest_from_json(spark, sf):
    path = new_dir(spark, "nbest")
    writers.write_nbest(_predicted(spark, sf), path)
    back = readers.read_nbest(spark, writers.prefixed(path, "nbest_predictions", None), whole_file=False)
    return back.select(
        "id", "rank", F.md5("text").alias("text_md5"), F.round("start_logit", 4).alias("start_logit"),
        F.round("end_logit", 4).alias("end_logit"), F.round("probability", 4).alias("probability"),
    )


def csv_roundtrip(spark, sf):
    corpus, questions = _corpus_table(spark, sf), _questions(spark, sf)
    hits = sparse.bm25_topk(questions, sparse.bm25_index(corpus), 10)
    texts = sparse.with_texts(hits, corpus).select("qid", "rank", "doc_id", "text")
    path = writers.write_csv(texts, new_dir(spark, "csv"))
    back = readers.read_rows(spark, path, "qid long, rank long, doc_id long, text string")
    return back.select("qid", "rank", "doc_id", F.md5("text").alias("text_md5"))


def bm25_persisted(spark, sf):
    index = stored.bm25_store(spark, new_dir(spark, "index"), _corpus(spark, sf), buckets=16)
    return _hits(sparse.bm25_topk(_questions(spark, sf), index, 10))


def bm25_persisted_single(spark, sf):
    index = stored.bm25_store(spark, new_dir(spark, "index"), _corpus(spark, sf), buckets=16)
    return _hits(stored.bm25_search_stored(spark, QUESTION, index, 10))


def reader_input(spark, sf):
    examples = _questions(spark, sf).withColumnRenamed("qid", "id")
    out = retrieval.reader_input(examples, _corpus_table(spark, sf))
    return out.select(F.md5("context").alias("context_md5"), "id", "question")


# --- corpus -------------------------------------------------------------------


def dedup_corpus(spark, sf):
    return _corpus(spark, sf).select("doc_id", F.md5("text").alias("text_md5"))


def concat_splits(spark, sf):
    docs = _load(spark, sf, "documents").select("doc_id", "lang", "text")
    items = _load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    both = co.concat(docs, items)
    return both.select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.md5("text").alias("text_md5"))


def drop_columns(spark, sf):
    return co.drop_columns(_load(spark, sf, "documents"), "text", "n_chars")


def hash_split(spark, sf):
    return co.hash_split(_load(spark, sf, "documents").select("doc_id"), "doc_id", 0.1)


def percent_slice(spark, sf):
    return co.percent_slice(_load(spark, sf, "documents").select("doc_id"), "doc_id", 5)


def take_first(spark, sf):
    return co.take_first(_load(spark, sf, "documents").select("doc_id", "lang"), 100)


def _lines(spark, sf):
    docs = _load(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def drop_blank_lines(spark, sf):
    kept = co.drop_blank_lines(_lines(spark, sf))
    return kept.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("text").alias("line_md5"))


def _cleaned(spark, sf, fn):
    docs = co.with_normalized(_load(spark, sf, "documents"), fn)
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


def normalize_ws(spark, sf):
    return _cleaned(spark, sf, tx.normalize_ws)


def compact_key(spark, sf):
    return _cleaned(spark, sf, tx.compact_key)


def normalize_answer(spark, sf):
    pages = co.with_normalized(_load(spark, sf, "pages"), tx.normalize_answer, "html")
    return pages.select("page_id", F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("n"))


def resolve_columns(spark, sf):
    """``question`` and ``context`` by position, ``text`` by name."""
    df = _load(spark, sf, "documents").select("lang", "text", "doc_id")
    picked = co.select_roles(df, {"question": 0, "text": 0, "id": 2})
    return picked.select("question", F.md5("text").alias("text_md5"), "id")


# --- tokens -------------------------------------------------------------------


def token_counts(spark, sf):
    tokens = tx.tokenize(F.col("text"))
    return _load(spark, sf, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct")
    )


def ngrams_12(spark, sf):
    grams = tx.ngrams(tx.tokenize(F.lower("text")), 1, 2)
    docs = _load(spark, sf, "documents").select("doc_id", grams.alias("g"))
    return docs.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("grams_md5"))


def pad_truncate(spark, sf):
    padded = tx.pad_truncate(tx.tokenize(F.col("text")), 512, F.lit("[PAD]"))
    docs = _load(spark, sf, "documents").select("doc_id", padded.alias("p"))
    total = F.aggregate("p.attention_mask", F.lit(0), lambda a, x: a + x)
    return docs.select("doc_id", F.md5(F.array_join("p.input_ids", " ")).alias("ids_md5"), total.cast("long").alias("n_real"))


def _tfidf_stored(spark, sf):
    corpus = _corpus_table(spark, sf)
    return corpus, *stored.tfidf_store(spark, new_dir(spark, "index"), corpus)


def tfidf_persisted(spark, sf):
    corpus, model, rows = _tfidf_stored(spark, sf)
    return _hits(tfidf.tfidf_topk(_questions(spark, sf), corpus, model, 10, rows=rows))


def tfidf_persisted_single(spark, sf):
    corpus, model, rows = _tfidf_stored(spark, sf)
    return _hits(tfidf.tfidf_search(spark, QUESTION, corpus, model, 10, rows))


def dense_persisted(spark, sf):
    given = _vectors(spark, sf, "doc_id").select("doc_id", "embedding")
    path = stored.index_path(new_dir(spark, "index"), "vectors", corpus="embeddings")
    vectors = stored.build_or_load(spark, path, lambda: {"vectors": given}, given)("vectors")
    return _hits(dense.dense_topk(_vectors(spark, sf, "qid"), vectors, 10))


def encode_truncated(spark, sf):
    """Passages cut to their encoder's input length."""
    docs = _load(spark, sf, "documents").select("doc_id", "text")
    cut = dense.encode(docs, dense.hash_encoder(), max_tokens=32).select("doc_id", F.posexplode("embedding").alias("dim", "v"))
    return cut.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 4).alias("v"))


# --- sparse retrieval -----------------------------------------------------------


def bm25_idf(spark, sf):
    terms = sparse.bm25_index(_corpus(spark, sf)).terms
    return terms.select("term", "df", F.round("idf", 4).alias("idf"))


def bm25_topk(spark, sf):
    return _hits(sparse.bm25_topk(_questions(spark, sf), sparse.bm25_index(_corpus(spark, sf)), 10))


def bm25_topk_block(spark, sf):
    """The same questions in several passes over the documents."""
    index = sparse.bm25_index(_corpus(spark, sf))
    return _hits(sparse.bm25_topk(_questions(spark, sf), index, 10, terms_per_pass=300))


def bm25_single(spark, sf):
    return _hits(sparse.bm25_search(spark, QUESTION, sparse.bm25_index(_corpus(spark, sf)), 10))


def tfidf_vocab(spark, sf):
    vocab = tfidf.tfidf_vocab(_corpus(spark, sf))
    return vocab.select("term", "total", "df", F.round("idf", 4).alias("idf"))


def tfidf_vectors(spark, sf):
    corpus = _corpus_table(spark, sf)
    model = tfidf.tfidf_fit(corpus)
    long = tfidf.tfidf_vectors(corpus, model)
    named = long.join(tfidf.tfidf_terms(spark, model), "term")
    return named.select("doc_id", F.col("name").alias("term"), F.round("weight", 4).alias("weight"))


def tfidf_topk(spark, sf):
    corpus = _corpus_table(spark, sf)
    return _hits(tfidf.tfidf_topk(_questions(spark, sf), corpus, tfidf.tfidf_fit(corpus), 10))


def tfidf_single(spark, sf):
    corpus = _corpus_table(spark, sf)
    return _hits(tfidf.tfidf_search(spark, QUESTION, corpus, tfidf.tfidf_fit(corpus), 10))


def oov_questions(spark, sf):
    """Words of the pages, a question each, that no term of the corpus is."""
    words = F.explode(F.array_distinct(tx.space_tokens(F.lower("html"))))
    asked = _load(spark, sf, "pages").select(words.alias("question")).distinct().select(F.col("question").alias("qid"), "question")
    return tfidf.oov_questions(asked, tfidf.tfidf_fit(_corpus_table(spark, sf))).select(F.md5("qid").alias("qid"))


def _lsa(spark, sf):
    """A stored model, and the stored projections of the corpus."""
    corpus = _corpus_table(spark, sf)
    return corpus, *stored.lsa_store(spark, new_dir(spark, "index"), corpus, tfidf.tfidf_fit(corpus), LSA_COMPONENTS)


def lsa_fit(spark, sf):
    """Each document's share in the first component, with the first singular value and the sum of all squares."""
    corpus, model, projected = _lsa(spark, sf)
    squares = tfidf.tfidf_rows(corpus, model.tfidf).agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))).scalar()
    first = F.abs(F.col("embedding")[0])
    return projected.select(
        "doc_id",
        F.round(first, 4).alias("first"),
        F.round(F.lit(model.singular_values[0] if model.singular_values else None), 4).alias("value"),
        F.round(squares, 4).alias("total"),
    )


def _best_by_sql(questions, projected, k):
    """The exact best hits, taken from stored projections with joins and a window only.

    Pairs are scored as they are joined: no row per component, and nothing but the best is shuffled. All
    pairs are compared with the question's score number ``k`` among some of the documents, and only
    those that reach it become rows and are sorted; components are columns there, so the comparison is compiled.
    """
    width = questions.agg(F.max(F.size("embedding"))).first()[0] or 0

    def wide(df, id_col, name):
        components = [F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{name}{i}") for i in range(width)]
        return df.where(F.size("embedding") > 0).select(id_col, F.col("embedding").alias(name), *components)

    q, d = wide(questions, "qid", "a"), wide(projected, "doc_id", "b")
    best = lambda pairs: top_k(pairs.select("qid", "doc_id", dot(F.col("a"), F.col("b")).alias("score")), "qid", k)
    some = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(BOUND_SHARE)) == 0).crossJoin(F.broadcast(q))
    # scores are compared after rounding to six digits
    bound = best(some).where(F.col("rank") == k).select("qid", (F.col("score") - 2e-6).alias("bound"))
    asked = q.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    products = [F.col(f"a{i}") * F.col(f"b{i}") for i in range(width)] or [F.lit(0.0)]
    while len(products) > 1:
        products = [x + y for x, y in zip(products[::2], products[1::2])] + products[len(products) // 2 * 2 :]
    near = d.join(F.broadcast(asked), products[0] >= F.col("bound"))
    return best(near).select("qid", "rank", F.col("score").alias("plain"))


def lsa_topk(spark, sf):
    """Each hit, and whether it is the one that joins and a window find among the stored projections."""
    corpus, model, projected = _lsa(spark, sf)
    questions = _questions(spark, sf)
    asked = materialized(lsa.lsa_vectors(questions, model, "question", id_col="qid"), "asked")
    hits = lsa.lsa_topk(questions, corpus, model, 10, vectors=projected)
    both = hits.join(_best_by_sql(asked, projected, 10), ["qid", "rank"], "left")
    return both.select("qid", "rank", (F.abs(F.col("score") - F.col("plain")) < 1e-3).alias("best"))


def ivf_lsa_topk(spark, sf):
    """Clustered search over the projections with every cell asked: whether it finds what joins and a window find."""
    corpus, model, projected = _lsa(spark, sf)
    questions = _questions(spark, sf)
    unit = projected.withColumn("embedding", l2_normalize(F.col("embedding")))
    index = stored.ivf_store(spark, new_dir(spark, "index"), projected, 8, encoder_name="lsa")
    options = retrieval.Options(k=10, tfidf=model.tfidf, lsa=model, lsa_vectors=projected, ivf=index, ivf_over="lsa", nprobe=8)
    hits = retrieval.find(questions, corpus, "ivf", options)
    asked = materialized(lsa.lsa_vectors(questions, model, "question", id_col="qid"), "asked")
    both = hits.join(_best_by_sql(asked, unit, 10), ["qid", "rank"], "left")
    return both.select("qid", "rank", (F.abs(F.col("score") - F.col("plain")) < 1e-3).alias("best"))


# --- dense retrieval ------------------------------------------------------------


def encode_hash(spark, sf):
    docs = _encoded(_load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    values = docs.select("doc_id", F.posexplode("embedding").alias("dim", "v"))
    return values.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 4).alias("v"))


def _dense(spark, sf, fn):
    return _hits(fn(_vectors(spark, sf, "qid"), _vectors(spark, sf, "doc_id"), 10))


def dense_topk(spark, sf):
    return _dense(spark, sf, dense.dense_topk)


def dense_topk_block(spark, sf):
    return _dense(spark, sf, dense.dense_topk_block)


def _question_vector() -> list[float]:
    return dense.hash_encoder()()(np.array([QUESTION], dtype=object))[0].tolist()


def dense_single(spark, sf):
    passages = _encoded(_corpus(spark, sf), "doc_id", "text")
    return _hits(dense.dense_search(spark, _question_vector(), passages, 10))


def l2_normalized(spark, sf):
    """Vectors moved off the unit sphere, normalised again."""
    e = _load(spark, sf, "embeddings").select("vec_id", F.transform(as_double(F.col("embedding")), lambda x: x * 3 + 1).alias("v"))
    unit = e.select("vec_id", l2_normalize(F.col("v")).alias("u"))
    values = unit.select("vec_id", F.posexplode("u").alias("dim", "u"))
    return values.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("u", 4).alias("u"))


def ivf_build(spark, sf):
    """Each vector with whether no cell is nearer than its own."""
    centroids, cells = ivf.ivf_build(_vectors(spark, sf, "doc_id"), 16)
    table = centroids.agg(F.collect_list(F.struct("cluster_id", "centroid"))).scalar()
    product = lambda c: dot(F.col("embedding"), c["centroid"])
    own = F.filter("table", lambda c: c["cluster_id"] == F.col("cluster_id"))
    nearest = F.array_max(F.transform("table", product)) - F.transform(own, product)[0] < 1e-5
    return cells.withColumn("table", table).select("doc_id", nearest.alias("nearest"))


def ivf_assign(spark, sf):
    assigned = ivf.ivf_assign(_vectors(spark, sf, "doc_id"), _centroids(spark, sf), "l2")
    return assigned.select("doc_id", F.col("cluster_id").cast("long").alias("cluster_id"))


def scalar_quantize(spark, sf):
    e = _load(spark, sf, "embeddings").select("vec_id", "embedding")
    coded = ivf.scalar_quantize(ivf.scalar_quantize(e, 8, out="c8"), 4, out="c4")
    decoded = ivf.scalar_decode(coded, ivf.quantizer_bounds(e), 8, "c8")
    first = F.round(F.aggregate("decoded", F.lit(0.0), lambda a, x: a + x), 4)
    return decoded.select("vec_id", F.array_join("c8", ",").alias("c8"), F.array_join("c4", ",").alias("c4"), first.alias("decoded_sum"))


def _ivf(spark, sf, metric, nprobe):
    hits = ivf.ivf_topk(_vectors(spark, sf, "qid"), _centroids(spark, sf), _cells(spark, sf, metric), 10, nprobe, metric)
    return _hits(hits)


def ivf_topk_ip(spark, sf):
    return _ivf(spark, sf, "inner_product", 1)


def ivf_topk_l2(spark, sf):
    return _ivf(spark, sf, "l2", 2)


def ivf_single(spark, sf):
    hits = ivf.ivf_search(spark, _question_vector(), _centroids(spark, sf), _cells(spark, sf, "inner_product"), 10)
    return _hits(hits)


def _code_cells(spark, sf, metric, bits):
    """Packed codes in a folder per cell, written and read back."""
    vectors = _vectors(spark, sf, "doc_id").select("doc_id", "embedding")
    centroids = _centroids(spark, sf)
    return stored.ivf_quantized_store(spark, new_dir(spark, "index"), vectors, metric=metric, bits=bits, centroids=centroids)


def ivf_quantized_topk(spark, sf):
    index = _code_cells(spark, sf, "inner_product", 8)
    return _hits(quantized.quantized_topk(_vectors(spark, sf, "qid"), index, 10, 2))


def ivf_quantized_l2(spark, sf):
    index = _code_cells(spark, sf, "l2", 4)
    return _hits(quantized.quantized_topk(_vectors(spark, sf, "qid"), index, 10, 1))


def ivf_quantized_single(spark, sf):
    return _hits(quantized.quantized_search(spark, _question_vector(), _code_cells(spark, sf, "l2", 8), 10, 2))


def ivf_persisted_single(spark, sf):
    vectors = _vectors(spark, sf, "doc_id").select("doc_id", "embedding")
    cells = stored.ivf_store(spark, new_dir(spark, "index"), vectors, metric="inner_product", centroids=_centroids(spark, sf))
    return _hits(stored.ivf_search_stored(spark, _question_vector(), *cells, 10))


# --- fusion ---------------------------------------------------------------------


def hybrid_topk(spark, sf):
    return _hits(retrieval.find(_questions(spark, sf), _corpus_table(spark, sf), "hybrid", retrieval.Options(dense_weight=5.0)))


def _contexts(spark, sf):
    corpus = _corpus_table(spark, sf)
    questions = _questions(spark, sf)
    hits = sparse.bm25_topk(questions, sparse.bm25_index(corpus), 10)
    return fusion.assemble_context(hits, corpus)


def assemble_context(spark, sf):
    return _contexts(spark, sf).select("qid", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n"))


def _gold_examples(spark, sf, corpus):
    """One example per gold pair, identified by question and passage."""
    gold = _gold(spark, sf, corpus)
    answers = F.struct(F.array(F.lit(0)).alias("answer_start"), F.array("question").alias("text"))
    return gold.select(
        F.concat_ws("-", "qid", "doc_id").alias("id"), "question", F.col("text").alias("context"), answers.alias("answers")
    )


def attach_gold(spark, sf):
    corpus = _corpus_table(spark, sf)
    out = retrieval.retrieve(_gold_examples(spark, sf, corpus), corpus)
    return out.select(
        "id", F.md5("context").alias("context_md5"), F.md5("original_context").alias("gold_md5"),
        F.md5(F.col("answers.text")[0]).alias("answer_md5"),
    )


def retrieve_flow(spark, sf):
    """BM25 over all documents for all benchmark questions, ready for the reader."""
    examples = _questions(spark, sf).withColumnRenamed("qid", "id")
    out = retrieval.retrieve(examples, _corpus_table(spark, sf))
    return out.select(
        "id", F.md5("question").alias("question_md5"), F.md5("context").alias("context_md5"),
        F.size(F.split("context", " ")).cast("long").alias("n_tokens"),
        F.contains("context", "question").cast("long").alias("has_question"),
    )


# --- metrics --------------------------------------------------------------------


def contains_accuracy(spark, sf):
    found = _questions(spark, sf).join(_contexts(spark, sf), "qid", "left")
    out = metrics.contains_accuracy(found.withColumn("context", F.coalesce("context", F.lit(""))), gold="question")
    return out.select("n", F.round("accuracy", 4).alias("accuracy"))


def _gold_hits(spark, sf):
    """Hits to depth 100 and the gold pairs."""
    corpus = _corpus_table(spark, sf)
    hits = sparse.bm25_topk(_questions(spark, sf), sparse.bm25_index(corpus), 100)
    return hits, _gold(spark, sf, corpus).select("qid", "doc_id")


def recall_at_k(spark, sf):
    out = metrics.recall_at_k(*_gold_hits(spark, sf))
    return out.select("k", F.round("recall", 4).alias("recall"))


def recall_detail(spark, sf):
    detail = metrics.recall_detail(*_gold_hits(spark, sf))
    return detail.select("qid", F.coalesce("best_rank", F.lit(-1)).alias("best_rank"), "is_in", "top_ids")


def squad_em(spark, sf):
    return metrics.squad_scores(*_answer_pairs(spark, sf)).select("id", "em")


def squad_f1(spark, sf):
    return metrics.squad_scores(*_answer_pairs(spark, sf)).select("id", F.round("f1", 4).alias("f1"))


def squad_metrics(spark, sf):
    out = metrics.squad_metrics(*_answer_pairs(spark, sf))
    return out.select("n", F.round("exact_match", 4).alias("exact_match"), F.round("f1", 4).alias("f1"))


def masked_accuracy(spark, sf):
    docs = _load(spark, sf, "documents").select("doc_id", "lang")
    rows = _load(spark, sf, "labels").join(docs, "doc_id")
    label = F.when(F.col("lang") == "de", metrics.IGNORED_LABEL).otherwise(F.col("toxic"))
    out = metrics.masked_accuracy(rows.select(F.col("quality").alias("prediction"), label.alias("label")))
    return out.select("n", F.round("accuracy", 4).alias("accuracy"))


def perplexity(spark, sf):
    loss = _load(spark, sf, "events").select((F.col("value") / 10).alias("loss"))
    return metrics.perplexity(loss).select(F.round("perplexity", 4).alias("perplexity"))


def _batched_vectors(spark, sf):
    e = F.col("embedding")
    return _load(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("batch"), F.col("vec_id").alias("item"), e.alias("q"),
        F.reverse(e).alias("p"), F.concat(F.slice(e, 33, 32), F.slice(e, 1, 32)).alias("hard"),
    )


def in_batch_nll(spark, sf):
    out = metrics.in_batch_nll(_batched_vectors(spark, sf))
    return out.select("batch", F.round("loss", 4).alias("loss"))


def in_batch_nll_hard(spark, sf):
    out = metrics.in_batch_nll(_batched_vectors(spark, sf), hard="hard")
    return out.select("batch", F.round("loss", 4).alias("loss"))


def best_so_far(spark, sf):
    events = _load(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    daily = events.groupBy(F.col("event_type").alias("metric"), day.alias("epoch")).agg(F.avg("value").alias("value"))
    out = metrics.best_so_far(daily)
    return out.select("metric", "epoch", F.round("value", 4).alias("value"), F.round("earlier_best", 4).alias("earlier_best"))


# --- training data ----------------------------------------------------------------


def hard_negatives(spark, sf):
    corpus = _corpus_table(spark, sf)
    out = prepare.hard_negatives(_gold_examples(spark, sf, corpus), corpus, sparse.bm25_index(corpus))
    return out.select("id", *[F.md5(f"passage_top{i}").alias(f"top{i}_md5") for i in (1, 2, 3)])


def chunk_windows(spark, sf):
    return _chunks(spark, sf).select(
        "id", "chunk", "context_start", "token_start", F.size("tokens").cast("long").alias("n_tokens"),
        F.col("offsets")[0]["s"].cast("long").alias("first_char"), F.element_at("offsets", -1)["e"].cast("long").alias("last_char"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def align_answer(spark, sf):
    return prepare.align_answer(_chunks(spark, sf)).select("id", "chunk", "start_position", "end_position")


def _word_chunks(spark, sf):
    return prepare.chunk_windows(_examples(spark, sf), tokenizer=tx.pattern_spans(r"[^ .,|!\n]+"))


def chunk_windows_words(spark, sf):
    """Windows of a tokenizer that drops punctuation and runs of spaces."""
    cut = _word_chunks(spark, sf).where(F.size("tokens") > 0)
    spans = F.transform("offsets", lambda o: o["s"] * 3 + o["e"])
    return cut.select(
        "id", "chunk", "token_start", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x).alias("offset_sum"),
    )


def align_answer_words(spark, sf):
    """Answer positions in windows of a tokenizer that sees whole batches in Python."""

    def load():
        word = re.compile(r"[^ .,|!\n]+")
        return lambda texts: [[m.span() for m in word.finditer(t)] for t in texts]

    chunks = prepare.chunk_windows(_examples(spark, sf), tokenizer=batch_spans(load, "words")).where(F.size("tokens") > 0)
    return prepare.align_answer(chunks).select("id", "chunk", "start_position", "end_position")


def inference_features(spark, sf):
    f = prepare.inference_features(_chunks(spark, sf))
    inside = F.filter("offset_mapping", lambda o: o.isNotNull())
    total = F.aggregate(inside, F.lit(0).cast("long"), lambda a, o: a + o["s"] + o["e"])
    return f.select(
        "id", "chunk", F.size("offset_mapping").cast("long").alias("n_positions"), F.size(inside).cast("long").alias("n_inside"), total.alias("offset_sum")
    )


def mlm_lines(spark, sf):
    out = prepare.mlm_lines(_lines(spark, sf))
    return out.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def pack_blocks(spark, sf):
    out = prepare.pack_blocks(_corpus(spark, sf))
    return out.select("batch", "block_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def mask_tokens(spark, sf):
    out = prepare.mask_tokens(prepare.hashed_ids(_load(spark, sf, "documents").select("doc_id", "text")))
    chosen = F.size(F.filter("labels", lambda x: x != prepare.IGNORED_LABEL)).cast("long")
    return out.select(
        "doc_id", chosen.alias("n_chosen"), F.md5(F.array_join("input_ids", " ")).alias("input_md5"), F.md5(F.array_join("labels", " ")).alias("labels_md5")
    )


def training_batches(spark, sf):
    docs = _load(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return prepare.training_batches(docs, 32).select("id", "batch", "position")


# --- answer spans -----------------------------------------------------------------


def top_positions(spark, sf):
    return spans.top_positions(_features(small_batches(spark), sf))


def span_pairs(spark, sf):
    out = spans.span_pairs(_features(small_batches(spark), sf))
    long = [F.col(c).cast("long").alias(c) for c in ("start_rank", "end_rank", "start_pos", "end_pos", "s", "e")]
    return out.select("id", "chunk", F.round("score", 4).alias("score"), *long)


def null_score(spark, sf):
    return spans.null_score(_features(small_batches(spark), sf)).select("id", F.round("null_score", 4).alias("null_score"))


def span_nbest(spark, sf):
    out = spans.span_nbest(_predicted(spark, sf))
    return out.select(
        "id", "rank", F.md5("text").alias("text_md5"), F.round("start_logit", 4).alias("start_logit"), F.round("end_logit", 4).alias("end_logit")
    )


def nbest_softmax(spark, sf):
    return spans.span_nbest(_predicted(spark, sf)).select("id", "rank", F.round("probability", 4).alias("probability"))


def best_answer(spark, sf):
    return spans.best_answer(_predicted(spark, sf)).select("id", F.md5("text").alias("text_md5"))


def best_answer_null(spark, sf):
    out = spans.best_answer(_predicted(spark, sf, with_null=True), with_null=True)
    return out.select("id", F.md5("text").alias("text_md5"), F.round("score_diff", 4).alias("score_diff"))


# --- prediction sets --------------------------------------------------------------


def agreement(spark, sf):
    out = ensemble.agreement(_answers(spark, sf, "base"), _answers(spark, sf, "partner"))
    return out.select("n", F.round("agreement", 4).alias("agreement"))


def differences(spark, sf):
    return ensemble.differences(_answers(spark, sf, "base"), _answers(spark, sf, "challenger"))


def _three(spark, sf):
    return _answers(spark, sf, "base"), [_answers(spark, sf, m) for m in ("partner", "challenger", "fourth")]


def diff_intersect(spark, sf):
    return ensemble.differs_from_all(*_three(spark, sf))


def diff_union(spark, sf):
    return ensemble.differs_from_any(*_three(spark, sf))


def side_by_side(spark, sf):
    sets = {m: _answers(spark, sf, m) for m in MODELS[:4]}
    return ensemble.side_by_side(sets, ("base", "challenger"))


def max_probability(spark, sf):
    return _confidence(spark, sf, "base").select("id", F.round("probability", 4).alias("probability"))


def confidence_summary(spark, sf):
    out = ensemble.confidence_summary(_confidence(spark, sf, "base"), (0.35, 0.5, 0.7))
    rounded = [F.round(c, 4).alias(c) for c in ("mean_p", "min_p", "max_p")]
    return out.select("n", *rounded, "below_35", "below_50", "below_70")


def pair_confidence(spark, sf):
    out = ensemble.pair_confidence(_confidence(spark, sf, "base"), _confidence(spark, sf, "partner"))
    return out.select("id", F.round("probability", 4).alias("probability"))


def ensemble_rules(spark, sf):
    flags = [F.col(f"rule{i}").cast("long").alias(f"rule{i}") for i in (1, 2, 3)]
    return _ruled(spark, sf).select("id", *flags)


def ensemble_flags(spark, sf):
    out = ensemble.ensemble_flags(_models(spark, sf), "base", "fourth", "fifth")
    return out.select("id", *[F.col(f"rule{i}").cast("long").alias(f"rule{i}") for i in (4, 5)])


def ensemble_apply(spark, sf):
    return ensemble.ensemble_apply(_ruled(spark, sf), "base", "challenger")


# --- profiling --------------------------------------------------------------------


def corpus_counts(spark, sf):
    return profile.corpus_counts(_load(spark, sf, "documents"))


def _stats(spark, sf, length):
    out = profile.length_stats(_load(spark, sf, "documents"), length)
    return out.select("n", "longest", "shortest", F.round("mean_length", 4).alias("mean_length"))


def length_stats(spark, sf):
    return _stats(spark, sf, profile.char_length())


def token_length_stats(spark, sf):
    return _stats(spark, sf, profile.token_length())


def length_histogram(spark, sf):
    return profile.length_histogram(_load(spark, sf, "documents"), profile.char_length())


def length_threshold(spark, sf):
    docs = _load(spark, sf, "documents")
    chars = profile.length_threshold(docs, profile.char_length(), 750)
    tokens = profile.length_threshold(docs, profile.token_length(), 401)
    return co.concat(chars.withColumn("unit", F.lit("char")), tokens.withColumn("unit", F.lit("token")))


# --- contract ---------------------------------------------------------------------


_QUERIES = (
    read_corpus_json, read_text_lines, flatten_nested_qa, qa_roundtrip, predictions_from_json, predictions_to_json,
    nbest_from_json, csv_roundtrip, bm25_persisted, bm25_persisted_single, tfidf_persisted, tfidf_persisted_single,
    dense_persisted, encode_truncated, chunk_windows_words, reader_input,
    dedup_corpus, concat_splits, drop_columns, hash_split, percent_slice, take_first, drop_blank_lines,
    normalize_ws, compact_key, normalize_answer, resolve_columns,
    token_counts, ngrams_12, pad_truncate,
    bm25_idf, bm25_topk, bm25_topk_block, bm25_single, tfidf_vocab, tfidf_vectors, tfidf_topk, tfidf_single, oov_questions,
    lsa_fit, lsa_topk, ivf_lsa_topk,
    encode_hash, dense_topk, dense_topk_block, dense_single, l2_normalized, ivf_build, ivf_assign, scalar_quantize,
    ivf_topk_ip, ivf_topk_l2, ivf_single, ivf_persisted_single, ivf_quantized_topk, ivf_quantized_l2, ivf_quantized_single,
    hybrid_topk, assemble_context, attach_gold, retrieve_flow,
    contains_accuracy, recall_at_k, recall_detail, squad_em, squad_f1, squad_metrics, masked_accuracy, perplexity,
    in_batch_nll, in_batch_nll_hard, best_so_far,
    hard_negatives, chunk_windows, align_answer, align_answer_words, inference_features, mlm_lines, pack_blocks, mask_tokens, training_batches,
    top_positions, span_pairs, null_score, span_nbest, nbest_softmax, best_answer, best_answer_null,
    agreement, differences, diff_intersect, diff_union, side_by_side, max_probability, confidence_summary, pair_confidence,
    ensemble_rules, ensemble_flags, ensemble_apply,
    corpus_counts, length_stats, token_length_stats, length_histogram, length_threshold,
)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: questions to reader contexts."""
    return retrieve_flow(spark, SMOKE_DIR)


def _extra():
    """The modules with further queries, if their subpackage is there."""
    try:
        from lectern.llm import queries as more
        from lectern.llm import statements
    except ModuleNotFoundError as missing:
        # only their own absence is no error, not that of a library they need
        if missing.name not in ("lectern.llm", "lectern.llm.queries", "lectern.llm.statements", "corpus_pipeline"):
            raise
        return None, None
    return more, statements


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more, _ = _extra()
    return {q.__name__: q for q in _QUERIES} | (more.queries() if more else {})


def oracle_sql() -> dict[str, str]:
    _, more = _extra()
    return oracle_queries.statements(QUESTION) | (more.statements() if more else {})

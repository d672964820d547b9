"""Text encoding and exact top-k over dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.vectors import as_double
from lectern.operators.ranking import SCORE_DIGITS, top_k

Encoder = Callable[[], Callable[[np.ndarray], np.ndarray]]
# Question vectors and passages as matrices to ``questions x passages`` scores.
Scores = Callable[[np.ndarray, np.ndarray], np.ndarray]

# A question side up to this many vectors is broadcast.
BROADCAST_VECTORS = 4096
QUESTIONS_PER_BLOCK = 1024
PASSAGES_PER_BLOCK = 16384
# Every block goes to all blocks of the other side, so a side has at most so many, unless they would be larger than a task may hold.
BLOCKS, ROWS_OF_BLOCK = 8, 131_072
# Questions and scores held at a time by one task.
QUESTIONS_AT_ONCE = 1024
SCORES_AT_ONCE = 2_000_000


def hash_encoder(dim: int = 64) -> Encoder:
    """Built-in encoder: signed hashed bag of space tokens, unit length.

    Bits 0-31 of a token's MD5 choose the component, the next hex digit the sign.
    """

    class Slots(dict):
        """Component of each token seen; tokens with a negative sign use ``dim`` and up."""

        def __missing__(self, token: str) -> int:
            digest = md5(token.encode()).hexdigest()
            slot = int(digest[:8], 16) % dim + (0 if digest[8] < "8" else dim)
            if len(self) >= 1 << 19:
                self.clear()
            self[token] = slot
            return slot

    def load() -> Callable[[np.ndarray], np.ndarray]:
        slots = Slots()

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                if text is not None:
                    counts = np.bincount([slots[t] for t in text.split(" ")], minlength=2 * dim)
                    out[row] = counts[:dim] - counts[dim:]
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)

        return encode

    return load


def encode(
    df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding", batch_size: int = 256, max_tokens: int | None = None
) -> DataFrame:
    """Add one vector per text. The encoder is loaded once per Python worker and fed in batches.

    ``max_tokens`` is the encoder's input length in space tokens, where it has one; questions
    and passages may differ in it.
    """
    run = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    own = F.col(text)
    if max_tokens is not None:
        own = F.array_join(F.slice(F.split(own, " "), 1, max_tokens), " ")
    return df.withColumn(out, run(own))


def dense_topk(
    questions: DataFrame, passages: DataFrame, k: int = 10, metric: str = "inner_product", vec: str = "embedding"
) -> DataFrame:
    """Exact top ``k`` of every question over all passages, ``(qid, rank, doc_id, score)``.

    Up to ``BROADCAST_VECTORS`` question vectors are broadcast as one matrix and passages
    stay where they are: each task keeps ``k`` hits per question. More questions go to
    ``dense_topk_block``.
    """
    block = questions.select("qid", as_double(F.col(vec))).limit(BROADCAST_VECTORS + 1).collect()
    if len(block) > BROADCAST_VECTORS:
        return dense_topk_block(questions, passages, k, metric, vec)
    spark = passages.sparkSession
    block = [r for r in block if r[1] is not None]
    ids = np.array([r[0] for r in block])
    matrix = spark.sparkContext.broadcast(np.array([r[1] for r in block], dtype=float))
    schema = f"qid {_type_of(questions, 'qid')}, doc_id {_type_of(passages, 'doc_id')}, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            # Null vectors are dropped here: a filter in the plan would run an encoder twice.
            batch = batch.filter(batch.column("v").is_valid())
            if batch.num_rows and len(ids):
                doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                hits = best_hits(ids, matrix.value, doc_ids, arrow_matrix(batch.column("v")), k, metric)
                best = hits if best is None else merge_hits(best, hits, k, metric)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    hits = passages.select("doc_id", F.col(vec).alias("v")).mapInArrow(scan, schema)
    return top_k(hits, "qid", k, largest=metric != "l2").select("qid", "rank", "doc_id", "score")


def dense_topk_block(
    questions: DataFrame, passages: DataFrame, k: int = 10, metric: str = "inner_product", vec: str = "embedding"
) -> DataFrame:
    """The same result with both sides distributed in blocks."""
    nq, np_ = (_blocks(df.agg(F.count("*")).scalar(), rows) for df, rows in ((questions, QUESTIONS_PER_BLOCK), (passages, PASSAGES_PER_BLOCK)))
    q = questions.select("qid", F.col(vec).alias("v"), F.lit(0).alias("cell"), nq.alias("nq"), np_.alias("np"))
    p = passages.select("doc_id", F.col(vec).alias("v"), F.lit(0).alias("cell"), nq.alias("nq"), np_.alias("np"))
    return _score_blocks(q, p, k, metric)


def dense_search(spark: SparkSession, vector: list[float], passages: DataFrame, k: int = 10, metric: str = "inner_product") -> DataFrame:
    """One question given as a vector."""
    one = spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, embedding array<double>")
    return dense_topk(one, passages, k, metric)


def cell_topk(
    questions: DataFrame,
    passages: DataFrame,
    k: int,
    metric: str,
    questions_per_block: int = QUESTIONS_PER_BLOCK,
    passages_per_block: int = PASSAGES_PER_BLOCK,
    scores: Scores | None = None,
    rows: Callable[[pd.Series], np.ndarray] | None = None,
) -> DataFrame:
    """Top ``k`` of questions ``(qid, v, cell)`` over the passages ``(doc_id, v, cell)`` of their cells.

    Passages that are no plain vectors need ``rows``, which makes a matrix of them, and ``scores``.

    A cell is cut into blocks by id hash according to its size on both sides, so one
    that holds most of the rows is spread over many tasks. Every pair of blocks of a
    cell meets in one task, which multiplies two matrices and returns at most ``k``
    rows per question.
    """
    # One row per cell, so both tables of block counts are small.
    q_blocks = questions.groupBy("cell").agg(_blocks(F.count("*"), questions_per_block).alias("nq"))
    p_blocks = passages.groupBy("cell").agg(_blocks(F.count("*"), passages_per_block).alias("np"))
    blocks = F.broadcast(q_blocks.join(p_blocks, "cell"))
    return _score_blocks(questions.join(blocks, "cell"), passages.join(blocks, "cell"), k, metric, scores, rows)


def _score_blocks(
    questions: DataFrame, passages: DataFrame, k: int, metric: str, scores: Scores | None = None, rows: Callable[[pd.Series], np.ndarray] | None = None
) -> DataFrame:
    """Send every question block to every passage block of its cell; ``nq`` and ``np`` are block counts."""
    every = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    q = questions.select("cell", (F.pmod(F.xxhash64("qid"), "nq") + 1).alias("qb"), every("np").alias("pb"), "qid", "v")
    p = passages.select("cell", every("nq").alias("qb"), (F.pmod(F.xxhash64("doc_id"), "np") + 1).alias("pb"), "doc_id", "v")
    schema = f"qid {_type_of(questions, 'qid')}, doc_id {_type_of(passages, 'doc_id')}, score double"

    def score(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        qs, ps = qs[qs["v"].notna()], ps[ps["v"].notna()]
        if not len(qs) or not len(ps):
            return pd.DataFrame({"qid": [], "doc_id": [], "score": []})
        return best_hits(qs["qid"].to_numpy(), _matrix(qs["v"]), ps["doc_id"].to_numpy(), (rows or _matrix)(ps["v"]), k, metric, scores)

    hits = q.groupBy("cell", "qb", "pb").cogroup(p.groupBy("cell", "qb", "pb")).applyInPandas(score, schema)
    return top_k(hits, "qid", k, largest=metric != "l2").select("qid", "rank", "doc_id", "score")


def _blocks(rows: Column, rows_per_block: int) -> Column:
    """Blocks of ``rows_per_block`` rows; of more where they would be more than ``BLOCKS``, up to ``ROWS_OF_BLOCK``."""
    few = F.least(F.ceil(rows / rows_per_block), F.lit(BLOCKS))
    return F.greatest(few, F.ceil(rows / max(ROWS_OF_BLOCK, rows_per_block)), F.lit(1)).cast("long")


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def arrow_matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(vectors), -1)


def similarity(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of ``q`` against all rows of ``p``."""
    product = q @ p.T
    if metric == "inner_product":
        return product
    if metric == "l2":
        squares = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :]
        return np.maximum(squares - 2 * product, 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def best_hits(qids: np.ndarray, q: np.ndarray, doc_ids: np.ndarray, p: np.ndarray, k: int, metric: str, scores: Scores | None = None) -> pd.DataFrame:
    """Best ``k`` passages of every question, scored in slices of bounded size."""
    if len(qids) > QUESTIONS_AT_ONCE:
        cut = [slice(at, at + QUESTIONS_AT_ONCE) for at in range(0, len(qids), QUESTIONS_AT_ONCE)]
        return pd.concat([best_hits(qids[c], q[c], doc_ids, p, k, metric, scores) for c in cut], ignore_index=True)
    step = max(k, SCORES_AT_ONCE // max(len(qids), 1))
    best, (number, known) = None, pd.factorize(qids)
    for at in range(0, len(p), step):
        bounds = None if best is None else _bounds(best, known, k, metric)[number]
        hits = _slice_hits(qids, q, doc_ids[at : at + step], p[at : at + step], k, metric, scores, bounds)
        best = hits if best is None else merge_hits(best, hits, k, metric) if len(hits) else best
    return best


def _bounds(best: pd.DataFrame, known: np.ndarray, k: int, metric: str) -> np.ndarray:
    """What a score has to reach to be among the best ``k`` of its question; the last is for questions without an id.

    Scores are compared after rounding, so the bound is some digits off.
    """
    worst = -1 if metric == "l2" else 1
    found = best.groupby("qid", sort=False)["score"].agg(["count", "min" if worst > 0 else "max"]).set_axis(["n", "last"], axis=1)
    last = found["last"].where(found["n"] >= k).reindex(known).to_numpy(float) - worst * 2.0 * 10.0**-SCORE_DIGITS
    return np.append(np.where(np.isnan(last), -worst * np.inf, last), -worst * np.inf)


def _slice_hits(
    qids: np.ndarray, q: np.ndarray, doc_ids: np.ndarray, p: np.ndarray, k: int, metric: str, scores: Scores | None, bounds: np.ndarray | None = None
) -> pd.DataFrame:
    """The best ``k`` of some passages for every question, or all that reach their question's bound where these are fewer."""
    order = np.argsort(doc_ids, kind="stable")
    doc_ids, p = doc_ids[order], p[order]
    table = similarity(q, p, metric) if scores is None else scores(q, p)
    if bounds is not None:
        near = table <= bounds[:, None] if metric == "l2" else table >= bounds[:, None]
        if np.count_nonzero(near) <= k * len(qids):
            rows, cols = np.nonzero(near)
            return pd.DataFrame({"qid": qids[rows], "doc_id": doc_ids[cols], "score": table[rows, cols]})
    keys = np.round(table, SCORE_DIGITS) * (1 if metric == "l2" else -1)
    kept = [_smallest(row, k) for row in keys]
    rows = np.repeat(np.arange(len(qids)), [len(c) for c in kept])
    cols = np.concatenate(kept)
    return pd.DataFrame({"qid": qids[rows], "doc_id": doc_ids[cols], "score": table[rows, cols]})


def _smallest(keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest keys; ties go to the smaller position."""
    if len(keys) <= k:
        return np.arange(len(keys))
    near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
    return near[np.argsort(keys[near], kind="stable")[:k]]


def merge_hits(a: pd.DataFrame, b: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    both = pd.concat([a, b], ignore_index=True)
    key = both["score"].round(SCORE_DIGITS) * (1 if metric == "l2" else -1)
    both = both.assign(key=key).sort_values(["qid", "key", "doc_id"])
    return both.groupby("qid", sort=False).head(k).drop(columns="key")

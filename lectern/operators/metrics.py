"""Retrieval, answer and loss metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrays import let, multiset_overlap
from lectern.functions.text import squad_normalize, squad_tokens
from lectern.functions.vectors import dot

# Depths at which recall is reported, and the label that is ignored.
RECALL_DEPTHS = (10, 20, 30, 50, 100)
IGNORED_LABEL = -100


def contains_accuracy(df: DataFrame, context: str = "context", gold: str = "original_context") -> DataFrame:
    """Percentage of rows whose gold text is part of the assembled context."""
    hit = F.contains(F.col(context), F.col(gold)).cast("double")
    return df.agg(F.count("*").alias("n"), (F.avg(hit) * 100).alias("accuracy"))


def recall_detail(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per gold pair ``(qid, doc_id)``: the rank it was found at and ``is_in`` for the first ``k``.

    The hit list is shown as ids in rank order.
    """
    marked = hits.select("qid", "doc_id", "rank").join(gold.select("qid", "doc_id", F.lit(True).alias("is_gold")), ["qid", "doc_id"], "left")
    # A question has at most the hits that were asked for; only the first k are listed.
    per_question = marked.groupBy("qid").agg(
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("best_rank"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "doc_id")))).alias("top"),
    )
    ids = F.array_join(F.transform("top", lambda x: x["doc_id"].cast("string")), " ")
    is_in = F.coalesce((F.col("best_rank") <= k).cast("long"), F.lit(0).cast("long"))
    return (
        gold.select("qid")
        .distinct()
        .join(per_question, "qid", "left")
        .select("qid", "best_rank", is_in.alias("is_in"), F.coalesce(ids, F.lit("")).alias("top_ids"))
    )


def recall_at_k(hits: DataFrame, gold: DataFrame, ks: Sequence[int] = RECALL_DEPTHS) -> DataFrame:
    """Percentage of gold questions with a gold document in the first k, one row per k."""
    found = gold.join(hits.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    best = found.groupBy("qid").agg(F.min("rank").alias("best_rank"))
    share = [(F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))) * 100).alias(f"k{k}") for k in ks]
    wide = best.agg(*share)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("recall")) for k in ks]))
    return wide.select(pairs.alias("p")).select("p.*")


def squad_scores(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Exact match and token F1 per ``id``, best over the reference texts.

    ``predictions(id, prediction_text)``, ``references(id, texts array<string>)``.
    """
    joined = predictions.join(references, "id")

    def compare(p: Column) -> Column:
        return F.transform("texts", lambda t: let(F.struct(squad_normalize(t).alias("text"), squad_tokens(t).alias("words")), lambda r: _scores(p, r)))

    prediction = F.struct(
        squad_normalize(F.col("prediction_text")).alias("text"), squad_tokens(F.col("prediction_text")).alias("words")
    )
    scores = joined.select("id", let(prediction, compare).alias("s"))
    return scores.select("id", F.array_max("s.em").alias("em"), F.array_max("s.f1").alias("f1"))


def _scores(p: Column, r: Column) -> Column:
    sizes = F.size(p["words"]) + F.size(r["words"])
    # 2PR/(P+R) with P and R taken from the same overlap.
    f1 = let(multiset_overlap(p["words"], r["words"]), lambda same: F.when(same > 0, 2.0 * same / sizes).otherwise(0.0))
    return F.struct((p["text"] == r["text"]).cast("double").alias("em"), f1.alias("f1"))


def squad_metrics(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Mean exact match and F1, in percent."""
    scores = squad_scores(predictions, references)
    return scores.agg(
        F.count("*").alias("n"), (F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1")
    )


def masked_accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Share of right predictions where the label is not the ignored one."""
    kept = df.where(F.col(label) != IGNORED_LABEL)
    return kept.agg(F.count("*").alias("n"), F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def perplexity(df: DataFrame, loss: str = "loss") -> DataFrame:
    """Exponential of the mean loss; infinite when it overflows."""
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def in_batch_nll(df: DataFrame, batch: str = "batch", item: str = "item", q: str = "q", p: str = "p", hard: str | None = None) -> DataFrame:
    """Mean negative log-likelihood of each question's own passage within its batch.

    Passages of the batch, and its hard negatives if given, are the candidates. A group
    is one training batch, so its size is the batch size; the products are formed inside
    the row and never become rows.
    """
    fields = [F.col(item).alias("item"), F.col(q).alias("q"), F.col(p).alias("p")]
    if hard:
        fields.append(F.col(hard).alias("h"))
    grouped = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    rows = F.col("rows")
    candidates = F.transform(rows, lambda r: r["p"])
    if hard:
        candidates = F.concat(candidates, F.transform(rows, lambda r: r["h"]))

    def losses(c: Column) -> Column:
        def loss(r: Column, i: Column) -> Column:
            return let(F.transform(c, lambda v: dot(r["q"], v)), lambda s: _log_sum_exp(s) - F.get(s, i))

        return F.transform(rows, loss)

    per_batch = grouped.select(batch, let(candidates, losses).alias("losses"))
    mean = F.aggregate("losses", F.lit(0.0), lambda a, x: a + x) / F.size("losses")
    return per_batch.select(batch, mean.alias("loss"))


def _log_sum_exp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))),
    )


def best_so_far(df: DataFrame, metric: str = "metric", epoch: str = "epoch", value: str = "value") -> DataFrame:
    """Epochs whose value strictly beats every earlier one of the same metric, starting from 0.

    A group holds one row per epoch of one metric.
    """
    earlier = Window.partitionBy(metric).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(value).over(earlier), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("earlier_best", best).where(F.col(value) > F.col("earlier_best"))

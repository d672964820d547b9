"""Mixing to target weights with soft membership.

A multinomial naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives every document a posterior over domains. Rates (how often a document is
used) are then fitted so that the expected tokens of each domain, the sum of rate x tokens x
posterior, meet the targets: least squares over nonnegative rates by accelerated projected
gradient. A step needs one vector of domain totals; a document's rate follows from the vectors
of all steps so far and its own posterior, so each step is one pass that sums a vector of the
domains' length, and no rate is ever moved or collected.

Defined cases: documents without words have the prior as posterior, no tokens and the rate
they started with; a domain without labelled rows is not predicted; with no labelled row at all,
or no tokens, every rate stays 1 (or ``floor``, if that is more). Repeated rows are rated each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import word_slices
from lectern.session import materialized

BUCKETS = 1 << 15
MADE = ("n_tokens", "domain", "posterior", "rate", "copies")


@dataclass
class Classifier:
    """Domains, log priors and log word frequencies (domains x buckets)."""

    domains: list[str]
    priors: np.ndarray
    logs: np.ndarray

    def posteriors(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``first row, row after the last, word counts, posteriors`` per slice.

        The evidence of ``n`` words counts as that of ``sqrt(n)``: neighbouring words are no
        independent draws, and a posterior that is always 0 or 1 is no soft membership.
        """
        for start, stop, words in word_slices(column):
            counts = np.diff(words.of)
            bucket, of = (words.hashes % np.uint64(BUCKETS)).astype(np.int64), words.text_of_word()
            sums = np.stack([np.bincount(of, row[bucket], stop - start) for row in self.logs], axis=1)
            scores = self.priors + sums / np.sqrt(np.maximum(counts, 1))[:, None]
            odds = np.exp(scores - scores.max(axis=1, keepdims=True))
            yield start, stop, counts, odds / odds.sum(axis=1, keepdims=True)


def classifier(labelled: DataFrame, text: str = "text", domain: str = "domain", max_rows: int = 20_000) -> Classifier:
    """Fit on at most ``max_rows`` labelled rows (those with the smallest hash of their text)."""
    rows = labelled.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{domain}`").cast("string").alias("_domain"))
    rows = rows.where("_text is not null and _domain is not null")
    order = F.xxhash64("_text")
    cut = rows.select(order.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    rows = rows.where(order <= F.lit(cut)) if cut is not None else rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for start, stop, words in word_slices(batch.column(0)):
                own = names[start:stop]
                for name in sorted(set(own)):
                    mine = own == name
                    bucket = (words.hashes[mine[words.text_of_word()]] % np.uint64(BUCKETS)).astype(np.int64)
                    keys, times = np.unique(np.append(bucket, -1), return_counts=True)
                    times[0] = mine.sum()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(times.astype(np.int64))],
                        names=["domain", "bucket", "times"],
                    )

    counts = rows.mapInArrow(run, "domain string, bucket long, times long").groupBy("domain", "bucket").agg(F.sum("times").alias("times"))
    table = counts.toPandas()
    domains = sorted(table["domain"].unique())
    matrix, texts = np.full((len(domains), BUCKETS), 0.5), np.zeros(len(domains))
    for k, name in enumerate(domains):
        mine = table[table["domain"] == name]
        words = mine[mine["bucket"] >= 0]
        matrix[k, words["bucket"].to_numpy(np.int64)] += words["times"].to_numpy()
        texts[k] = mine.loc[mine["bucket"] < 0, "times"].sum()
    logs = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return Classifier(domains, np.log(texts / texts.sum()) if len(domains) else texts, logs)


def members(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posterior`` (in the order of the model's domains)."""
    keep = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, counts, shares in shared.value.posteriors(batch.column(batch.num_columns - 1)):
                begins = np.arange(stop - start + 1, dtype=np.int32) * shares.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(start, stop - start) for c in batch.columns[:-1]),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(begins), pa.array(shares.ravel())),
                    ],
                    names=[*batch.schema.names[:-1], "n_tokens", "posterior"],
                )

    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens long", "posterior array<double>"]))


@dataclass
class Fit:
    """What a document's rate follows from: step width, floor, and each step's gradient."""

    width: float
    floor: float
    steps: list[np.ndarray]

    def rates(self, shares: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after all steps for rows of posteriors; ``ahead``: the point of the next gradient."""
        old = now = point = np.full(len(shares), max(1.0, self.floor))
        t = 1.0
        for residual in self.steps:
            old, now = now, np.maximum(self.floor, point - self.width * (shares @ residual))
            longer = (1 + np.sqrt(1 + 4 * t * t)) / 2
            point, t = now + (t - 1) / longer * (now - old), longer
        return point if ahead else now


def _sums(table: DataFrame, k: int, make) -> np.ndarray:
    """The sum over all rows of a vector that ``make(tokens, posteriors)`` gives per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                shares = batch.column(1).flatten().to_numpy().reshape(-1, k)
                part = make(batch.column(0).to_numpy().astype(float), shares).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    found = table.select("n_tokens", "posterior").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = found.toPandas().sort_values("at")
    return out["value"].to_numpy(float)


def fit(
    table: DataFrame, targets: np.ndarray, budget: float | None = None, floor: float = 0.0, rounds: int = 40, tolerance: float = 1e-4
) -> Fit:
    """Fit rates for rows ``n_tokens, posterior``: domain ``k`` gets ``targets[k] * budget`` tokens.

    ``budget`` defaults to the tokens there are, or with a floor to the least number of tokens with
    which every domain can keep all its documents. Ends when all domains are within ``tolerance``
    of the budget, or after ``rounds`` passes.
    """
    k = len(targets)
    start = max(1.0, floor)
    if not k:
        return Fit(0.0, floor, [])
    both = _sums(table, k, lambda t, p: np.concatenate([t @ p, ((p * t[:, None]).T @ p).ravel()]))
    if not len(both) or both[:k].sum() <= 0:
        return Fit(0.0, floor, [])
    have, gram = both[:k], both[k:].reshape(k, k)
    if budget is None:
        budget = max(float((floor * have / np.maximum(targets, 1e-9)).max()), 0.0) if floor else float(have.sum())
    state = Fit(float(budget / np.linalg.eigvalsh(gram).max()), floor, [])
    total = have * start
    for _ in range(rounds):
        residual = total / budget - targets
        if np.abs(residual).max() < tolerance and state.steps:
            break
        state.steps.append(residual)
        total = _sums(table, k, lambda t, p: (t * state.rates(p, ahead=True)) @ p)
    return state


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    floor: float = 0.0,
    budget: float | None = None,
    max_rows: int = 20_000,
    rounds: int = 40,
) -> DataFrame:
    """The id, ``n_tokens, domain`` (the likeliest), ``posterior, rate, copies`` of every row.

    ``copies`` is the rate made whole: its floor, and one more for a share of the documents that
    a hash of the id picks. Weights of domains that are not predicted are shared out again.
    """
    model = classifier(labelled, text, domain, max_rows)
    k = len(model.domains)
    ids = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias(text))
    if not k:
        nothing = F.array().cast("array<double>")
        rated = ids.select(
            F.col(doc_id), F.lit(0).cast("long").alias("n_tokens"), nothing.alias("posterior"), F.lit(max(1.0, floor)).alias("rate"),
            F.lit(None).cast("string").alias("domain"),
        )
    else:
        table = materialized(members(ids, model, text).drop(text), "members")
        wanted = np.array([weights.get(d, 0.0) for d in model.domains])
        wanted = wanted / wanted.sum() if wanted.sum() > 0 else np.full(k, 1.0 / k)
        state = fit(table, wanted, budget, floor, rounds)
        names = model.domains

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shares = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                best = shares.argmax(axis=1) if len(shares) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(state.rates(shares)), pa.array([names[b] for b in best], pa.string())],
                    names=[*batch.schema.names, "rate", "domain"],
                )

        kind = table.schema[doc_id].dataType.simpleString()
        rated = table.select(doc_id, "n_tokens", "posterior").mapInArrow(
            run, f"`{doc_id}` {kind}, n_tokens long, posterior array<double>, rate double, domain string"
        )
    whole = F.floor("rate")
    luck = F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    copies = (whole + F.when(luck < F.col("rate") - whole, 1).otherwise(0)).cast("long")
    return rated.select(doc_id, "n_tokens", "domain", "posterior", "rate", copies.alias("copies"))


def repeated(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as its ``copies`` say (rows of an unknown id once)."""
    times = rates.groupBy(doc_id).agg(F.max("copies").alias("_copies"))
    joined = docs.join(times, doc_id, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)).cast("int"))
    return joined.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*(f"`{c}`" for c in docs.columns))

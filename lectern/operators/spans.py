"""From start/end logits to ranked answer texts.

Features are rows ``(id, chunk, offset_mapping, start_logits, end_logits)``; an offset is
null outside the context. All work within a feature stays inside its row, and each
feature passes on at most ``n`` candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import let, rows_of
from lectern.functions.offsets import ends_of, places

# Candidates kept, longest answer in tokens, text used when nothing is left.
N_BEST = 20
MAX_ANSWER_LENGTH = 30
EMPTY_TEXT = "empty"
# Numbers in a matrix of features: their positions or their pairs. A task has several Python workers, so matrices are small.
NUMBERS_AT_ONCE = 1 << 18
# The place of a null answer, and a key below those of all logits.
NULL_PLACE = ("start_rank", "end_rank", "start_pos", "end_pos", "s", "e")
NOTHING = np.int64(np.iinfo(np.int64).min)


def best_positions(logits: Column, n: int = N_BEST) -> Column:
    """Positions of the ``n`` largest logits; ties go to the larger position."""
    indexed = F.transform(logits, lambda x, i: F.struct(x.cast("double").alias("logit"), i.alias("pos")))
    return F.slice(F.sort_array(indexed, asc=False), 1, n)


def top_positions(features: DataFrame, n: int = N_BEST) -> DataFrame:
    """Long form ``(id, chunk, side, rank, pos, logit)``."""

    def ranked(side: str) -> Column:
        return F.transform(
            best_positions(F.col(f"{side}_logits"), n),
            lambda x, i: F.struct(F.lit(side).alias("side"), (i + 1).cast("long").alias("rank"), x["pos"].cast("long").alias("pos"), x["logit"].alias("logit")),
        )

    both = F.concat(ranked("start"), ranked("end"))
    return rows_of(features, ["id", "chunk"], both, "p").select("id", "chunk", "p.*")


def _best(logits: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Positions and keys of the ``n`` largest logits of each row, -1 where there are fewer, and all values.

    Like in a sort by Spark, NaN is the largest value and null the smallest.
    """
    at, values = ends_of(logits), logits.values.cast(pa.float64())
    counts = np.diff(at)
    wide = np.full((len(logits), max(int(counts.max(initial=0)), 1)), NOTHING)
    inside = np.arange(wide.shape[1]) < counts[:, None]
    wide[inside] = _ordered(values)[places(at[:-1], counts)]
    # the last position first, so that a stable sort gives it the smaller rank
    order = np.argsort(~wide[:, ::-1], axis=1, kind="stable")[:, :n]
    best = wide.shape[1] - 1 - order
    return np.where(np.take_along_axis(inside, best, 1), best, -1), at, values


def _ordered(values: pa.Array) -> np.ndarray:
    """Whole numbers in the order of Spark's doubles: null, numbers (both zeros are equal), NaN."""
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    bits = x.view(np.int64)
    key = np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)
    key = np.where(np.isnan(x), np.int64(0x7FFF_FFFF_FFFF_FFFF), key)
    return np.where(values.is_null().to_numpy(zero_copy_only=False), NOTHING + 1, key)


def _flags(lists: pa.Array, positions: np.ndarray, flags: pa.Array) -> np.ndarray:
    """The flag at each row's positions, false outside of its list."""
    at = ends_of(lists)
    counts = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
    known = (positions >= 0) & (positions < counts[:, None])
    where = np.where(known, at[:-1, None] + positions, 0)
    marks = np.concatenate([flags.to_numpy(zero_copy_only=False).astype(bool), [False]])
    return known & marks[where]


def _pairs(features: pa.RecordBatch, max_answer_length: int, n: int, max_context: str | None, keep: int | None) -> dict[str, pa.Array]:
    """Columns of the valid pairs of a batch, and ``row``, the feature of each; the best ``keep`` of every feature if given."""
    start, end, offsets = (features.column(c) for c in ("start_logits", "end_logits", "offset_mapping"))
    (s, s_at, s_values), (e, e_at, e_values) = _best(start, n), _best(end, n)
    inside = offsets.values.is_valid()
    begins = _flags(offsets, s, inside)
    if max_context is not None:
        marked = features.column(max_context)
        begins &= _flags(marked, s, marked.values.fill_null(False))
    width = e[:, None, :] - s[:, :, None]
    valid = begins[:, :, None] & _flags(offsets, e, inside)[:, None, :] & (width >= 0) & (width < max_answer_length)
    row, i, j = np.nonzero(valid)
    s, e = s[row, i], e[row, j]
    start_logit, end_logit = s_values.take(pa.array(s_at[row] + s)), e_values.take(pa.array(e_at[row] + e))
    cost = pc.negate(pc.add(start_logit, end_logit))
    if keep is not None:
        order = np.lexsort((_ordered(cost), row))
        counts = np.bincount(row, minlength=len(start))
        order = order[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < keep]
        row, i, j, s, e = (x[order] for x in (row, i, j, s, e))
        start_logit, end_logit, cost = (x.take(pa.array(order)) for x in (start_logit, end_logit, cost))
    at = ends_of(offsets)[row]
    whole = lambda x: pa.array(x, pa.int32())
    return {
        "row": pa.array(row), "cost": cost, "start_rank": whole(i), "end_rank": whole(j), "start_pos": whole(s), "end_pos": whole(e),
        "start_logit": start_logit, "end_logit": end_logit,
        "s": pc.struct_field(offsets.values, "s").take(pa.array(at + s)), "e": pc.struct_field(offsets.values, "e").take(pa.array(at + e)),
    }


def _pair_rows(features: DataFrame, max_answer_length: int, n: int, max_context: str | None, keep: int | None, with_null: bool) -> DataFrame:
    """One row per valid pair, and with ``with_null`` one per feature with its class token's logits, all in numpy matrices of a batch.

    A feature without logits has no rows.
    """
    null = [F.col(f"{side}_logits")[0].cast("double").alias(f"_{side}") for side in ("start", "end")] if with_null else []
    wanted = ["id", "chunk", "offset_mapping", "start_logits", "end_logits", *([max_context] if max_context is not None else [])]
    # rows without logits are left out below: a filter in the plan would have the logits worked out twice
    given = features.select(*wanted, *null)
    offset = given.schema["offset_mapping"].dataType.elementType
    whole, number = T.IntegerType(), T.DoubleType()
    schema = T.StructType([
        T.StructField("id", given.schema["id"].dataType), T.StructField("chunk", given.schema["chunk"].dataType),
        T.StructField("is_null", T.BooleanType()), T.StructField("cost", number),
        *(T.StructField(c, whole) for c in ("start_rank", "end_rank", "start_pos", "end_pos")),
        T.StructField("start_logit", number), T.StructField("end_logit", number),
        T.StructField("s", offset["s"].dataType), T.StructField("e", offset["e"].dataType),
    ])

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(batch, max_answer_length, n, max_context, keep)
        row = pairs.pop("row")
        owner = {c: batch.column(c).take(row) for c in ("id", "chunk")}
        found = owner | {"is_null": pa.array(np.zeros(len(row), bool))} | pairs
        yield pa.RecordBatch.from_pydict({c: found[c] for c in schema.names})
        if with_null:
            start, end = batch.column("_start"), batch.column("_end")
            zero = {c: pa.array(np.zeros(len(batch.column(0)), np.int32)).cast(pairs[c].type) for c in NULL_PLACE}
            null = {"id": batch.column("id"), "chunk": batch.column("chunk"), "is_null": pa.array(np.ones(len(start), bool))}
            null |= zero | {"cost": pc.add(start, end), "start_logit": start, "end_logit": end}
            yield pa.RecordBatch.from_pydict({c: null[c] for c in schema.names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, n):
                yield from rows(part)

    return given.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """The features with logits, some at a time, in buffers of their own: no step works on the values of the whole batch."""
    for first, stop in _slices(batch, n):
        part = batch.slice(first, stop - first)
        yield part.filter(pc.and_(part.column("start_logits").is_valid(), part.column("end_logits").is_valid()))


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of features whose matrices have at most ``NUMBERS_AT_ONCE`` numbers; a larger feature is one of its own."""
    widths = np.maximum(np.diff(ends_of(batch.column("start_logits"))), np.diff(ends_of(batch.column("end_logits"))))
    # a feature has a row in two matrices of positions and one in a matrix of pairs
    sizes = np.maximum(np.maximum(widths, np.minimum(widths, n) ** 2), 1).tolist()
    first = widest = 0
    for at, size in enumerate(sizes):
        widest = max(widest, size)
        if at > first and widest * (at + 1 - first) > NUMBERS_AT_ONCE:
            yield first, at
            first, widest = at, size
    if first < len(sizes):
        yield first, len(sizes)


def span_pairs(
    features: DataFrame, n: int = N_BEST, max_answer_length: int = MAX_ANSWER_LENGTH, max_context: str | None = None, keep: int | None = None
) -> DataFrame:
    """Valid start/end pairs per feature, one row each; the best ``keep`` of every feature if given."""
    pairs = _pair_rows(features, max_answer_length, n, max_context, keep, False)
    columns = ["start_rank", "end_rank", "start_pos", "end_pos", "start_logit", "end_logit", "s", "e"]
    return pairs.select("id", "chunk", (-F.col("cost")).alias("score"), *columns)


def null_score(features: DataFrame) -> DataFrame:
    """Per example the smallest class-token score over its features, with its two logits."""
    first = lambda c: F.col(c)[0].cast("double")
    scored = features.select(
        "id", "chunk", first("start_logits").alias("start_logit"), first("end_logits").alias("end_logit")
    ).withColumn("score", F.col("start_logit") + F.col("end_logit"))
    best = F.min(F.struct("score", "chunk", "start_logit", "end_logit"))
    return scored.groupBy("id").agg(best.alias("b")).select(
        "id", F.col("b.score").alias("null_score"), F.col("b.start_logit").alias("start_logit"), F.col("b.end_logit").alias("end_logit")
    )


def predictions(
    examples: DataFrame,
    features: DataFrame,
    n: int = N_BEST,
    max_answer_length: int = MAX_ANSWER_LENGTH,
    with_null: bool = False,
    max_context: str | None = None,
) -> DataFrame:
    """One row per example ``(id, null_score, nbest)``, best answer first.

    ``nbest`` is an array of ``(text, start_logit, end_logit, score, probability)``. It
    holds at most ``n`` entries, one more for a null answer that was ranked out.
    Features are read once: each sends its ``n`` best spans and its null answer.
    """
    rows = _pair_rows(features, max_answer_length, n, max_context, n, with_null)
    # Spans compete for the largest score, null answers for the smallest.
    order = Window.partitionBy("id", "is_null").orderBy("cost", "chunk", "start_rank", "end_rank")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    entry = F.struct("rank", "start_logit", "end_logit", (F.col("start_logit") + F.col("end_logit")).alias("score"), "s", "e")
    grouped = kept.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_null"), entry))).alias("spans"),
        F.min(F.when(F.col("is_null"), entry)).alias("null"),
    )
    joined = examples.select("id", "context").join(grouped, "id", "left")
    found = F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType))
    chosen = let(found, lambda x: _with_null(x, F.col("null"), n)) if with_null else found

    def answer(x: Column) -> Column:
        text = F.substring(F.col("context"), x["s"] + 1, x["e"] - x["s"])
        return F.struct(text.alias("text"), x["start_logit"].alias("start_logit"), x["end_logit"].alias("end_logit"), x["score"].alias("score"))

    answers = let(F.transform(chosen, answer), _never_empty)
    return joined.select("id", F.col("null.score").alias("null_score"), let(answers, softmax).alias("nbest"))


def _with_null(spans: Column, null: Column, n: int) -> Column:
    """Put the null answer at its place; it loses ties, and is appended when it ranks below ``n``."""
    merged = F.slice(
        F.concat(
            F.filter(spans, lambda x: x["score"] >= null["score"]), F.array(null), F.filter(spans, lambda x: x["score"] < null["score"])
        ),
        1,
        n,
    )
    ranked_in = lambda m: F.exists(m, lambda x: (x["s"] == 0) & (x["e"] == 0))
    complete = let(merged, lambda m: F.when(ranked_in(m), m).otherwise(F.concat(m, F.array(null))))
    return F.when(null.isNotNull(), complete).otherwise(spans)


def _never_empty(answers: Column) -> Column:
    zero = F.lit(0.0)
    filler = F.struct(F.lit(EMPTY_TEXT).alias("text"), zero.alias("start_logit"), zero.alias("end_logit"), zero.alias("score"))
    blank = (F.size(answers) == 0) | ((F.size(answers) == 1) & (F.get(answers, F.lit(0))["text"] == ""))
    return F.when(blank, F.concat(F.array(filler), answers)).otherwise(answers)


def softmax(answers: Column) -> Column:
    """Add ``probability`` to every entry of an answer array."""

    def shares(top: Column) -> Column:
        total = F.aggregate(answers, F.lit(0.0), lambda acc, x: acc + F.exp(x["score"] - top))
        return let(
            total,
            lambda t: F.transform(answers, lambda x: x.withField("probability", F.exp(x["score"] - top) / t)),
        )

    return let(F.array_max(F.transform(answers, lambda x: x["score"])), shares)


def span_nbest(predicted: DataFrame) -> DataFrame:
    """Long form ``(id, rank, text, start_logit, end_logit, score, probability)``."""
    return predicted.select("id", F.posexplode_outer("nbest").alias("pos", "a")).select(
        "id", (F.col("pos") + 1).cast("long").alias("rank"), "a.*"
    )


def best_answer(predicted: DataFrame, with_null: bool = False, threshold: float = 0.0) -> DataFrame:
    """``(id, text)``, and ``score_diff`` when null answers are allowed.

    With null answers the first non-blank text counts; it is replaced by an empty answer
    when the null score beats it by more than ``threshold``.
    """
    if not with_null:
        return predicted.select("id", F.col("nbest")[0]["text"].alias("text"))
    first = F.get(F.filter("nbest", lambda x: x["text"] != ""), F.lit(0))
    chosen = predicted.select("id", "null_score", first.alias("best"))
    diff = F.col("null_score") - F.col("best.start_logit") - F.col("best.end_logit")
    text = F.when(diff > threshold, "").otherwise(F.coalesce("best.text", F.lit("")))
    return chosen.select("id", text.alias("text"), diff.alias("score_diff"))

"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each shingle is hashed once; the high bits of the hash choose a bin, the rest compete for the
bin's minimum. An empty bin copies a bin that a hash of (bin, attempt) points at, with growing
attempts until that bin was not empty; the choice depends on nothing but the bin, so equal
bins are copied alike in all texts. Of every minimum the four low bits are kept as one hex
digit. Likeness is the share of equal digits, corrected for chance.

Defined cases: a text without words has the empty fingerprint; two such texts are alike (1.0),
one such text is like no other (0.0). A text with fewer words than a shingle has one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import flat, mix, shingles, slices, words_of

BINS = 256
SHINGLE = 5
BITS = 4
EMPTY = np.uint64(np.iinfo(np.uint64).max)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
MAX_BUCKETS = 20_000
BUCKET_BYTES = 24 << 20


def minima(column: pa.Array, shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the densified bin minima, one row per text, and which texts have words."""
    data, offsets = flat(column)
    out = np.zeros((len(offsets) - 1, bins), np.uint8)
    some = np.zeros(len(offsets) - 1, bool)
    shift = np.uint64(64 - int(np.log2(bins)))
    for start, stop in slices(offsets):
        text, hashes = shingles(words_of(data, offsets[start : stop + 1]), shingle)
        least = np.full((stop - start) * bins, EMPTY)
        np.minimum.at(least, text * bins + (hashes >> shift).astype(np.int64), hashes & np.uint64((1 << 48) - 1))
        least = densified(least.reshape(-1, bins))
        some[start:stop] = least[:, 0] != EMPTY
        out[start:stop] = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return out, some


def densified(least: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a filled one."""
    bins = least.shape[1]
    filled = least != EMPTY
    row, hole = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, attempt = least.copy(), 0
    while len(row):
        attempt += 1
        ask = mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt))
        giver = (ask % np.uint64(bins)).astype(np.int64)[hole]
        hit = filled[row, giver]
        out[row[hit], hole[hit]] = least[row[hit], giver[hit]]
        row, hole = row[~hit], hole[~hit]
    return out


def packed(digits: np.ndarray, some: np.ndarray) -> list[str]:
    """One hex digit per bin; empty where the text has no words."""
    joined = HEX[digits].tobytes().decode()
    width = digits.shape[1]
    return [joined[i * width : (i + 1) * width] if ok else "" for i, ok in enumerate(some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated similarity row by row: equal digits, less those equal by chance."""
    chance = 1.0 / (1 << BITS)
    equal = (a == b).mean(axis=1) if a.shape[1] else np.ones(len(a))
    corrected = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, corrected, np.where(some_a | some_b, 0.0, 1.0))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """``docs`` with a ``fingerprint`` column (replacing one of that name)."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = packed(*minima(batch.column(batch.num_columns - 1), shingle, bins))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "fingerprint"]
            )

    return rows.mapInArrow(run, ", ".join([*fields, "fingerprint string"]))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt into ranges of the id: ``_id, _text, _bucket, _tail``, sorted in each partition.

    The last range row of a bucket is followed by a ``_tail`` row, a copy of the document that
    comes next in the whole table (after the last: the first). Texts are shuffled once; only cut
    points and the first id of each bucket, at most ``MAX_BUCKETS`` numbers, reach the driver.
    Ids sort as numbers, null first; rows with equal ids sort by text.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("_key"),
    )
    size = rows.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    wanted = max(1, min(MAX_BUCKETS, int((size[0] or 0) / BUCKET_BYTES) + 1, max(1, size[1])))
    place = F.col("_key").cast("double")
    cuts = rows.select(place.alias("_place")).approxQuantile("_place", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    split = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket")

    def bucketed(df: DataFrame) -> DataFrame:
        placed = df.withColumn("_place", place)
        out = split.transform(placed) if len(splits) > 2 else placed.withColumn("_bucket", F.lit(0.0))
        return out.withColumn("_bucket", F.col("_bucket").cast("int")).drop("_place")

    firsts = sorted((r[0], r[1]) for r in bucketed(rows.select("_key")).groupBy("_bucket").agg(F.min("_key")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    starts = F.broadcast(spark.createDataFrame(before, "_key long, _before int"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t"))
    next_to = F.struct(F.col("_before").alias("b"), F.lit(1).alias("t"))
    dealt = bucketed(rows).join(starts, "_key", "left")
    dealt = dealt.withColumn("_at", F.explode_outer(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, next_to))))
    dealt = dealt.select("_id", "_text", "_key", F.col("_at.b").alias("_bucket"), F.col("_at.t").alias("_tail"))
    return dealt.repartitionByRange(len(firsts) or 1, "_bucket").sortWithinPartitions("_bucket", "_tail", "_key", "_text")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Columns: the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A table of one row is followed by itself.
    """
    ordered = in_order(docs, doc_id, text).select("_id", "_text", "_bucket", "_tail")
    kind = ordered.schema["_id"].dataType.simpleString()
    schema = (
        f"`{doc_id}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(at, 2000)])
                rows = pa.concat_tables([held, part]) if held is not None else part
                if rows.num_rows > 1:
                    yield from pairs(rows)
                held = rows.slice(rows.num_rows - 1)

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, tail, bucket = rows["_text"].to_pylist(), rows["_tail"].to_numpy(), rows["_bucket"].to_numpy()
        digits, some = minima(rows["_text"])
        here = np.flatnonzero((tail[:-1] == 0) & (bucket[:-1] == bucket[1:]))
        if not len(here):
            return
        edited = [edited_text(texts[i], texts[i + 1]) for i in here]
        edited_digits, edited_some = minima(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                rows["_id"].combine_chunks().take(pa.array(here)),
                pa.array([len(texts[i]) for i in here], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(packed(digits[here], some[here]), pa.string()),
                pa.array(packed(edited_digits, edited_some), pa.string()),
                pa.array(likeness(digits[here], some[here], edited_digits, edited_some)),
                pa.array(likeness(digits[here], some[here], digits[here + 1], some[here + 1])),
            ],
            names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return ordered.mapInArrow(run, schema)

"""Importance resampling of documents towards a target set by hashed n-gram features.

A text becomes lower-case words (A-Z only) between delimiters. The distinct words of a slice
of texts, each between two spaces, go into an Aho-Corasick automaton whose entries carry the
word's CRC and length; one scan of the slice then emits these payloads in the order of the
words, with a mark between texts. A run of words is composed from the payloads next to each
other: the CRC of two joined strings follows from their CRCs and the second one's length, so
no run is ever built as a string. Buckets are CRCs modulo a number.

Two passes read the texts, each in Arrow batches without a shuffle of rows: one counts buckets
(tasks add up their own, Spark adds the tasks), one adds the gains of a document's features. The
driver holds one number per bucket. Documents above the quota are found by sorting scores in
ranges and numbering each range; no task sees all of them.

Defined cases: a null text, and one without words, has no features and weight 0; rows with
equal or null ids are documents of their own (a null id comes last among equal scores); a
very long text is a slice of its own; empty tables give an empty result; extra columns do not
matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.words import flat, slices
from lectern.session import materialized

BUCKETS = 10_000
SLICE = 1 << 22
_POLYNOMIAL = 0xEDB88320
_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Bytes of words as they are, A-Z lower-cased, everything else a space.
_PLAIN = bytearray(b" " * 256)
for _b in _KEEP:
    _PLAIN[_b] = _b
for _b in range(0x41, 0x5B):
    _PLAIN[_b] = _b + 0x20
_PLAIN = bytes(_PLAIN)
#: Stands between two texts; not a word byte.
_MARK = "\n"


# --- checksums of joined strings ---


def _zero_bytes() -> list[np.ndarray]:
    """For each power of two, four tables that carry a CRC over so many zero bytes."""
    columns = np.array([1 << k for k in range(32)], np.uint32)
    one = np.where(columns & 1, np.uint32(_POLYNOMIAL), np.uint32(0)) ^ (columns >> 1)

    def through(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for k in range(32):
            out ^= np.where(values >> np.uint32(k) & 1, operator[k], np.uint32(0))
        return out

    for _ in range(3):
        one = through(one, one)
    tables = []
    for _ in range(32):
        every = np.arange(256, dtype=np.uint32)
        tables.append(np.stack([through(one, every << np.uint32(8 * k)) for k in range(4)]))
        one = through(one, one)
    return tables


_ZEROS = _zero_bytes()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of each ``first`` string followed by the ``second`` one of ``length`` bytes."""
    out = first.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        t, v = _ZEROS[k], out[at]
        out[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return out ^ second.astype(np.uint32)


# --- features ---


def payloads(texts: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, crc, length)`` of the words of texts that lie one after the other in ``texts``, up to ``ends``."""
    plain = texts.translate(_PLAIN).decode("latin-1")
    bounds = [0, *ends.tolist()]
    scanned = "".join([f" {plain[a:b]} {_MARK}" for a, b in zip(bounds, bounds[1:], strict=False)])
    automaton = ahocorasick.Automaton()
    for word in set().union(*(text.split(" ") for text in scanned.split(_MARK))) - {""}:
        raw = word.encode("latin-1")
        automaton.add_word(f" {word} ", zlib.crc32(raw) << 31 | len(raw))
    automaton.add_word(_MARK, -1)
    automaton.make_automaton()
    emitted = np.fromiter(map(itemgetter(1), automaton.iter(scanned)), np.int64)
    mark = emitted < 0
    words = emitted[~mark]
    return np.cumsum(mark)[~mark], (words >> 31).astype(np.uint32), words & ((1 << 31) - 1)


def run_buckets(text: np.ndarray, crc: np.ndarray, length: np.ndarray, n: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of all runs of 1 to ``n`` words, joined by one space."""
    texts, found = [text], [crc.astype(np.int64) % buckets]
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    runs = crc
    for size in range(2, n + 1):
        # the run so far starts at each place but the last; its next word stands size - 1 places on
        runs = runs[:-1]
        then, wide = crc[size - 1 :], length[size - 1 :]
        spaced = joined_crc(runs, space[: len(runs)], np.ones(len(runs), np.int64))
        runs = joined_crc(spaced, then, wide)
        same = text[: len(runs)] == text[size - 1 :]
        texts.append(text[: len(runs)][same])
        found.append(runs[same].astype(np.int64) % buckets)
    return np.concatenate(texts), np.concatenate(found)


def features(column: pa.Array, n: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, words per text, text, bucket)`` for each slice of a string column."""
    data, offsets = flat(column)
    for start, stop in slices(offsets, SLICE):
        base = offsets[start]
        text, crc, length = payloads(data[base : offsets[stop]].tobytes(), offsets[start + 1 : stop + 1] - base)
        yield start, stop, np.bincount(text, minlength=stop - start), *run_buckets(text, crc, length, n, buckets)


def bucket_counts(df: DataFrame, n: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch.column(0), n, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source probability of each bucket, one added to every count."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    each = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in each], np.int64)


def weighted(df: DataFrame, gain: np.ndarray, n: int = 1, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), ``n_words``, ``n_features`` and ``weight``, the sum of the features' gains."""
    made = ("n_words", "n_features", "weight")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{c} long" for c in made]
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, stop, words, text, found in features(batch.column(batch.num_columns - 1), n, len(own)):
                size = stop - start
                # whole numbers below 2**53 are exact in the sums of bincount
                sums = np.bincount(text, own[found], size).astype(np.int64)
                counts = np.bincount(text, minlength=size)
                kept = batch.slice(start, size).columns[:-1]
                columns = [*kept, *(pa.array(x.astype(np.int64)) for x in (words, counts, sums))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *made])

    return rows.mapInArrow(run, ", ".join(fields))


# --- the draw ---


def gumbel(id_col: str, seed: int) -> Column:
    """Thousandths of a Gumbel number that follows from the id; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, quota: Column, order: list[Column]) -> DataFrame:
    """Add ``rank`` (1, 2, ...) in the given order; null beyond ``quota``, a column that is the same in all rows.

    Rows are sorted in ranges and numbered within each; the sizes of the ranges before are
    added. The rows in their order are written once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialized(placed, "ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    numbered = rows.join(F.broadcast(starts), "_range").withColumn("rank", F.when(number <= quota, number))
    return numbered.drop("_range", "_at", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """All documents with ``n_features``, ``weight``, ``score`` and ``rank``.

    ``percent`` of the documents with at least ``min_words`` words are drawn without
    replacement: those with the highest sum of weight and Gumbel number; the others' rank is
    null. ``keep`` are the columns that go with a document (default all).
    """
    gain = gains(bucket_counts(docs, n, buckets, text), bucket_counts(target, n, buckets, text))
    columns = list(dict.fromkeys([id_col, *(docs.columns if keep is None else keep)]))
    scored = weighted(docs, gain, n, text, [c for c in columns if c not in ("score", "rank")])
    scored = materialized(scored.withColumn("score", F.col("weight") + gumbel(id_col, seed)), "scores")
    long_enough = scored.where(F.col("n_words") >= min_words)
    quota = F.lit(percent * long_enough.count() // 100)
    order = [F.desc("score"), F.asc_nulls_last(f"`{id_col}`"), F.asc("weight"), F.asc("n_features")]
    drawn = ranked(long_enough, quota, order)
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def facts(resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return resampled.select(F.col(f"`{id_col}`"), "n_features", "weight", "score", "rank")

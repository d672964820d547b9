"""Repeated byte strings by a distributed difference-cover suffix array.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

1. *Regions.* Texts with equal bytes are one text from here on. In each text the smallest hash
   of every window of k-grams marks an anchor (``minimizers``). Two equal strings of ``length``
   bytes have the same anchor at the same place. The places an anchor can have in a string fall into
   ``HALVES`` ranges; all strings that have it in one range share more than half of their bytes, so only
   text around anchors whose shared bytes occur again can hold a repeat. Nothing else is sorted.
2. *Suffix array.* In these regions denser anchors cut the text into blocks. The suffixes that
   start at anchors are sorted as strings of block names with the difference-cover algorithm:
   names for the triples at two of three places by a distributed sort, recursion on the names,
   merging of the remaining suffixes by two more sorts. The next anchor depends on no byte but
   those of the block behind an anchor, so this order is the byte order. The recursion ends
   where names cover ``length`` bytes.
3. *Adjacent prefixes.* Neighbours in that order have the longest common prefix. They tell how
   many of the places before an anchor can begin a repeat, and an anchor whose whole context
   equals its neighbour's is settled. The remaining places are told apart by their strings' hashes,
   within a task first and then, one or two of each string, in buckets.

Each distributed sort deals rows by their key and then by document, so equal keys do not meet
in one task; only a few numbers per partition go through the driver, and the keys of a sample of documents that cut
the ranges, so that rows are built once.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeats never
cross texts; overlapping repeats of one text count; rows with equal texts of ``length`` bytes
or more lose all of them, also where an id is null or occurs twice, since texts are told apart by
their digests and not by their ids, which may be of any type. With ``min_words`` only runs of repeated bytes that hold that many
whole words are cut, and a text that is repeated as a whole goes if it has that many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.quality import BREAKS
from lectern.llm.words import chain, flat, mix, powers, prefix_hashes, range_hashes, slices
from lectern.session import materialized, scratch_mark

LENGTH = 400
STEPS = 8
#: Ranges of an anchor's place in a string; the bytes that all strings of a range share are told apart.
HALVES = 2
#: Documents, at least, whose keys cut the ranges of a sort, and the share of their rows that is taken.
SAMPLED_DOCS, SAMPLED_ROWS = 1_000, 8
#: Texts and their anchors that a task compares on its own before it sends one of each to the others.
HELD_ROWS = 250_000
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Sizes:
    """K-gram and window sizes that follow from the length of a repeat."""

    length: int

    @property
    def sparse(self) -> tuple[int, int]:
        k = max(1, self.length * 4 // 25)
        return k, self.length - k + 1

    @property
    def dense(self) -> tuple[int, int]:
        return max(1, self.length * 2 // 25), max(1, self.length * 10 // 25)

    @property
    def block(self) -> int:
        """Bytes behind an anchor that settle where the next anchor is."""
        return sum(self.dense) + 1

    @property
    def ladder(self) -> list[int]:
        """Distances of a string's start from its anchor at which common prefixes are compared."""
        w = self.dense[1]
        return sorted({w * j // STEPS for j in range(STEPS)} | {w - 1})


# --- anchors ---


def minimizers(data: np.ndarray, offsets: np.ndarray, k: int, w: int, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """``segment, anchor, first, last``: for each anchor the places whose window it is the minimum of.

    The window of a place ``p`` holds the ``w`` k-grams from ``p`` on and lies in one segment.
    Of equal hashes the last one counts. ``sums`` are the prefix hashes of ``data``.
    """
    nothing = tuple(np.empty(0, np.int64) for _ in range(4))
    m = len(data) - k + 1
    if m < w:
        return nothing
    _, down = powers(m)
    h = mix((sums[k:] - sums[:-k]) * down)
    key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    rows = -(-m // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max)
    grid[:m] = key
    grid = grid.reshape(rows, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: m - w + 1], before[w - 1 : m])
    mark = np.zeros(len(data) + 2, np.int32)
    starts, stops = offsets[:-1], offsets[1:] - (w + k - 1) + 1
    fits = stops > starts
    np.add.at(mark, starts[fits], 1)
    np.add.at(mark, stops[fits], -1)
    p = np.flatnonzero(np.cumsum(mark[: m - w + 1]) > 0)
    if not len(p):
        return nothing
    x = (_LOW - (least[p] & _LOW)).astype(np.int64)
    # windows do not cross segments, so places are missing where one ends
    new = np.ones(len(p), bool)
    new[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    return np.searchsorted(offsets, p[at], "right") - 1, x[at], p[at], p[np.append(at[1:], len(p)) - 1]


def shared_bytes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, ...]:
    """``anchor, range, start, stop, lo, hi``: for each anchor and range of distances of a string's start from it,
    the bytes ``[start, stop)`` that all these strings share, and the places at which they start."""
    w, found = sizes.sparse[1], []
    for j in range(HALVES):
        near, far = w * j // HALVES, w * (j + 1) // HALVES - 1
        low, high = np.maximum(lo, x - far), np.minimum(hi, x - near)
        at = np.flatnonzero(low <= high) if near <= far else np.empty(0, np.int64)
        found.append((at, np.full(len(at), j), x[at] - near, x[at] - far + sizes.length, low[at], high[at]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _long_lists(values: np.ndarray, begins: np.ndarray, kind=np.int64) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.astype(kind)))


_SKETCH = (
    "doc_id string, text_key long, n_bytes long, sha string, found array<struct<lo: int, stop: int>>, "
    "bucket int, a array<int>, of array<long>, lo array<int>, more array<int>"
)


def _repeated(a: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """``order, again, told``: rows in the order of ``a``; which of them share it with another text or place; and
    enough of them, at most two of each ``a``, to tell this to whoever meets the same ``a`` elsewhere."""
    order = np.argsort(a, kind="stable")
    a, key, lo = a[order], key[order], lo[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    other = (key != key[head][group]) | (lo != lo[head][group])
    again = np.zeros(len(head), bool)
    again[group[other]] = True
    _, second = np.unique(group[other], return_index=True)
    told = new.copy()
    told[np.flatnonzero(other)[second]] = True
    return order, again[group], told


def sketches(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows of two kinds. With ``bucket`` null, one per row: ``doc_id`` (as a string), ``text_key, n_bytes, sha`` and ``found``,
    the places ``[lo, stop)`` of shared bytes that a task's other rows have too. Else shared bytes of many texts, as lists:
    the hash of the bytes, dealt into ``bucket`` and ``a``, their text, where strings begin and how many places follow."""
    k, w = sizes.sparse
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors(ids: pa.Array, own: np.ndarray, bounds: np.ndarray) -> tuple:
        sums = prefix_hashes(own)
        segment, x, lo, hi = minimizers(own, bounds, k, w, sums)
        anchor, half, first, last, lo, hi = shared_bytes(x, lo, hi, sizes)
        segment = segment[anchor]
        a = chain(range_hashes(sums, first, last), half.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        at = bounds[:-1][segment] if len(segment) else np.empty(0, np.int64)
        shas = [hashlib.sha256(own[b:e].tobytes()).digest() for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return ids, np.diff(bounds), shas, segment, a, (lo - at).astype(np.int32), (hi - at).astype(np.int32)

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, n_bytes, shas, rows, a, lo, hi = zip(*held, strict=True)
        firsts = np.cumsum([0, *map(len, ids)])
        rows = np.concatenate([r + f for r, f in zip(rows, firsts[:-1], strict=True)])
        shas = [s for some in shas for s in some]
        keys = np.array([int.from_bytes(s[:8], "big", signed=True) for s in shas], np.int64)
        a, lo, hi = (np.concatenate(c) for c in (a, lo, hi))
        order, again, told = _repeated(a, keys[rows], lo)
        here = order[again]
        here = here[np.argsort(rows[here], kind="stable")]
        places = pa.StructArray.from_arrays([pa.array(lo[here]), pa.array(hi[here] + np.int32(sizes.length))], ["lo", "stop"])
        begins = np.searchsorted(rows[here], np.arange(len(keys) + 1)).astype(np.int32)
        names = ["doc_id", "text_key", "n_bytes", "sha", "found", "bucket", "a", "of", "lo", "more"]
        n, kinds = len(keys), [pa.int32(), *(pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
        facts = [pa.concat_arrays(ids), pa.array(keys), pa.array(np.concatenate(n_bytes)), pa.array([s.hex() for s in shas], pa.string())]
        found = pa.ListArray.from_arrays(pa.array(begins), places)
        yield pa.RecordBatch.from_arrays([*facts, found, *(pa.nulls(n, t) for t in kinds)], names=names)
        some = order[told]
        bucket = ((a[some] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        some, bucket = some[by], bucket[by]
        own, begins = np.unique(bucket, return_index=True)
        begins = np.append(begins, len(some))
        lists = [
            _long_lists((a[some] & _LOW).astype(np.uint32).view(np.int32), begins, np.int32), _long_lists(keys[rows[some]], begins),
            _long_lists(lo[some], begins, np.int32), _long_lists(hi[some] - lo[some], begins, np.int32),
        ]
        empty = [pa.nulls(len(own), c.type) for c in (*facts, found)]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(own), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for start, stop in slices(offsets, 1 << 20):
                bounds = offsets[start : stop + 1]
                held.append(anchors(batch.column(0).slice(start, stop - start), data[bounds[0] : bounds[-1]], bounds - bounds[0]))
                size += len(held[-1][3]) + stop - start
                if size >= HELD_ROWS:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    return rows.mapInArrow(run, _SKETCH)


def regions(sketch: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """``doc_id, text_key, spans`` for one row per distinct text: where repeats can lie, as ``[start, stop)``.

    Bytes are told apart by a hash: what meets another by chance makes a region too many, never one too few.
    """
    parts = int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = sketch.where("bucket is not null").select("bucket", "a", "of", "lo", "more").repartitionById(parts, F.col("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            a, of, lo, more = (batch.column(c).flatten().to_numpy() for c in ("a", "of", "lo", "more"))
            bucket = np.repeat(batch.column("bucket").to_numpy(), batch.column("a").value_lengths().to_numpy())
            held.append([bucket.astype(np.int64) << 32 | a.view(np.uint32), of, lo, more])
        if not held:
            return
        a, of, lo, more = (np.concatenate(c) for c in zip(*held, strict=True))
        order, again, _ = _repeated(a, of, lo)
        some = order[again]
        of, lo, stop = of[some], lo[some], lo[some] + more[some] + np.int32(length)
        for at in range(0, len(some), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in (of, lo, stop)], names=["text_key", "lo", "stop"])

    firsts = classes.select("rep", F.col("text_key").alias("_key"))
    own = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    here = sketch.where("size(found) > 0").select("doc_id", "text_key", "found").join(firsts, own, "left_semi")
    spans = lists.mapInArrow(run, "text_key long, lo int, stop int").union(here.select("text_key", F.inline("found")))
    spans = spans.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("lo", "stop"))).alias("spans"))
    return spans.join(firsts, F.col("text_key") == F.col("_key")).select(F.col("rep").alias("doc_id"), "text_key", "spans")


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted ``[start, stop)`` rows with those that touch joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def _pairs(lists: pa.Array, i: int) -> np.ndarray:
    """The list of two-field structs in row ``i`` as an ``n x 2`` array."""
    values = lists[i].values
    if values is None or len(values) == 0:
        return np.empty((0, 2), np.int64)
    return np.stack([values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)], axis=1)


@dataclass
class Blocks:
    """Dense anchors of one document: place in its text, range of string starts, place in the sequence."""

    data: np.ndarray
    sums: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    index: np.ndarray
    ends: np.ndarray
    shift: np.ndarray
    count: int

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return range_hashes(self.sums, start, stop)


def blocks_of(text: bytes | memoryview, spans: np.ndarray, sizes: Sizes) -> Blocks:
    """The blocks of a document's regions; each region's sequence ends with a separator."""
    whole = np.frombuffer(text, np.uint8)
    spans = merged(spans)
    data = np.concatenate([whole[a:b] for a, b in spans]) if len(spans) else np.empty(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])]).astype(np.int64)
    sums = prefix_hashes(data)
    segment, x, lo, hi = minimizers(data, offsets, *sizes.dense, sums)
    ends = offsets[1:][segment] if len(x) else np.empty(0, np.int64)
    hi = np.minimum(hi, ends - sizes.length)
    shift = (spans[:, 0] - offsets[:-1])[segment] if len(x) else np.empty(0, np.int64)
    index = np.arange(len(x)) + segment
    return Blocks(data, sums, x, lo, hi, index, ends, shift, len(x) + len(spans))


# --- distributed order ---


def _key_bytes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Two longs per row that tell its key: the numbers themselves, hashed if there are more."""
    if pa.types.is_binary(columns[0].type):
        data, offsets = flat(columns[0])
        own = data[offsets[0] : offsets[-1]]
        sums = prefix_hashes(own)
        at = offsets - offsets[0]
        h = range_hashes(sums, at[:-1], at[1:])
        return h, (at[1:] - at[:-1]).astype(np.uint64)
    numbers = [c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in columns]
    if len(numbers) == 2:
        return numbers[0], numbers[1]
    return numbers[0], numbers[1] << np.uint64(32) ^ mix(numbers[2])


def _sort_keys(batch: pa.RecordBatch, keys: list[str], width: int) -> np.ndarray:
    """The sort key of each row, then its document and place, as byte strings of one length in the same order.

    ``width`` is the most bytes of a binary key.
    """
    columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "i")]
    parts = []
    if width:
        data, offsets = flat(batch.column(keys[0]))
        lengths = np.diff(offsets)
        padded = np.zeros((batch.num_rows, width), np.uint8)
        padded[np.arange(width) < lengths[:, None]] = data[offsets[0] : offsets[-1]]
        parts.append(padded)
        columns = [lengths, *columns]
    else:
        columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys] + columns
    numbers = (np.stack(columns, axis=1).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    joined = np.concatenate([*parts, numbers.view(np.uint8).reshape(batch.num_rows, 8 * len(columns))], axis=1)
    return np.ascontiguousarray(joined).view(f"S{joined.shape[1]}").ravel()


def _dealt(frame: DataFrame, rows: Callable[..., DataFrame], keys: list[str], width: int, parts: int) -> DataFrame:
    """The rows in ``parts`` ranges of their sort keys, cut at the keys of a sample of the documents.

    ``repartitionByRange`` would build every row twice, once to take a sample.
    """
    some = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, frame.count() // SAMPLED_DOCS))) == 0

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = chain(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("doc_id", "i")))
        few = _sort_keys(batch.filter(pa.array(at % np.uint64(SAMPLED_ROWS) == 0)), keys, width)
        size = few.dtype.itemsize
        whole = few.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([whole[k : k + size] for k in range(0, len(whole), size)], pa.binary())], names=["key"])

    found = sorted(bytes(r["key"]) for r in rows(frame.where(some), sampled, "key binary").collect())
    cuts = [found[len(found) * k // parts] for k in range(1, parts)] if found else []

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = np.zeros(batch.num_rows, np.int32)
        for at in range(0, batch.num_rows if cuts else 0, 1 << 16):
            own = _sort_keys(batch.slice(at, 1 << 16), keys, width)
            part[at : at + len(own)] = np.searchsorted(np.array(cuts, own.dtype), own, "right")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return rows(frame, placed, None).repartitionById(parts, F.col("part")).drop("part")


def less_counts(frame: DataFrame, rows: Callable[..., DataFrame], keys: list[str], own: bool, width: int = 0) -> DataFrame:
    """``doc_id, i, v`` of the rows ``doc_id, i, cls, base`` and sort keys that ``rows`` builds from the documents of ``frame``.

    ``v`` counts the rows with a smaller key: for class 0 those of class 1 (and of class 0, if
    ``own``) and ``base``; for class 1 those of class 0, and ``base``. One global sort; partitions
    tell the driver their totals and their first and last key.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(frame, rows, keys, width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, group = np.zeros(2, np.int64), np.zeros(2, np.int64)
        last, first, first_group = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            k0, k1 = _key_bytes([batch.column(c) for c in keys])
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            new = np.ones(len(k0), bool)
            new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
            head = (int(k0[0]), int(k1[0]))
            new[0] = last is None or head != last
            first = head if first is None else first
            ones = np.concatenate([[0], np.cumsum(cls == 1)]).astype(np.int64)
            zeros = np.arange(len(cls) + 1) - ones
            at = np.flatnonzero(new)
            owner = np.cumsum(new) - 1
            start0 = np.concatenate([[group[0]], before[0] + zeros[at]])[owner + 1]
            start1 = np.concatenate([[group[1]], before[1] + ones[at]])[owner + 1]
            opening = np.zeros(len(k0), bool)
            if first_group:
                began = at[at > 0] if last is None else at
                opening[: began[0] if len(began) else len(k0)] = True
                first_group = not len(began)
            if len(at):
                group = np.array([before[0] + zeros[at[-1]], before[1] + ones[at[-1]]])
            before = before + np.array([zeros[-1], ones[-1]])
            last = (int(k0[-1]), int(k1[-1]))
            yield _out(batch.column("doc_id"), batch.column("i"), cls, batch.column("base"), part, start0, start1, opening)
        if last is not None:
            facts = [first[0], first[1], last[0], last[1], *before.tolist(), *group.tolist(), int(first_group)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
                + [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_())]
                + [pa.array([[int(np.int64(np.uint64(f).view(np.int64))) if j < 4 else int(f) for j, f in enumerate(facts)]], pa.list_(pa.int64()))],
                names=["doc_id", "i", "cls", "base", "part", "l0", "l1", "opening", "facts"],
            )

    def _out(doc, i, cls, base, part, l0, l1, opening) -> pa.RecordBatch:
        n = len(cls)
        return pa.RecordBatch.from_arrays(
            [
                doc, i, pa.array(cls.astype(np.int32)), base, pa.array(np.full(n, part, np.int32)), pa.array(l0), pa.array(l1),
                pa.array(opening), pa.nulls(n, pa.list_(pa.int64())),
            ],
            names=["doc_id", "i", "cls", "base", "part", "l0", "l1", "opening", "facts"],
        )

    schema = "doc_id long, i long, cls int, base long, part int, l0 long, l1 long, opening boolean, facts array<long>"
    done = materialized(dealt.sortWithinPartitions(*keys).mapInArrow(run, schema), "sorted")
    shifts, total, group, previous = [], [0, 0], [0, 0], None
    for part, facts in sorted((r["part"], r["facts"]) for r in done.where("facts is not null").select("part", "facts").collect()):
        first, last, counts, begun, single = tuple(facts[:2]), tuple(facts[2:4]), facts[4:6], facts[6:8], facts[8]
        goes_on = previous == first
        opened = group if goes_on else list(total)
        shifts.append((part, *total, *opened))
        group = opened if single else [t + b for t, b in zip(total, begun, strict=True)]
        total, previous = [t + c for t, c in zip(total, counts, strict=True)], last
    table = F.broadcast(spark.createDataFrame(shifts, "part int, t0 long, t1 long, o0 long, o1 long"))
    less0 = F.when(F.col("opening"), F.col("o0")).otherwise(F.col("t0") + F.col("l0"))
    less1 = F.when(F.col("opening"), F.col("o1")).otherwise(F.col("t1") + F.col("l1"))
    value = F.when(F.col("cls") == 0, less1 + (less0 if own else F.lit(0))).otherwise(less0) + F.col("base")
    return done.where("facts is null").join(table, "part").select("doc_id", "i", value.alias("v"))


def _gathered(values: DataFrame, frame: DataFrame, size: Callable[[int], int]) -> DataFrame:
    """``doc_id, s, r``: the values of each document summed into an array of ``size(len(s))`` places."""
    lists = values.groupBy("doc_id").agg(F.collect_list("i").alias("at"), F.collect_list("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, at, v in zip(*(batch.column(c) for c in ("n", "at", "v")), strict=True):
                r = np.zeros(size(n.as_py()), np.int64)
                if at.values is not None:
                    np.add.at(r, at.values.to_numpy(), v.values.to_numpy())
                out.append(r)
            begins = np.concatenate([[0], np.cumsum([len(r) for r in out])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _long_lists(np.concatenate(out) if out else np.empty(0, np.int64), begins)], names=["doc_id", "r"]
            )

    return frame.select("doc_id", "n").join(lists, "doc_id", "left").mapInArrow(run, "doc_id long, r array<long>")


def _samples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places 1 and 2 modulo 3 of a string of length ``n``; one more if the first kind would end without padding."""
    top = n + (n % 3 == 1)
    return np.arange(1, top, 3), np.arange(2, n, 3)


def _rows(doc, columns: dict[str, np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc.take(pa.array(np.repeat(np.arange(len(counts)), counts))), *(pa.array(c) for c in columns.values())],
        names=["doc_id", *columns],
    )


def _exploded(columns: list[str], make: Callable[..., dict[str, np.ndarray]], schema: str) -> Callable[..., DataFrame]:
    """Builds rows with ``make`` from the arrays of each document of a frame; ``finish`` turns batches into those of another schema."""

    def rows(frame: DataFrame, finish: Callable, other: str | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    made = [make(*(c.values.to_numpy() for c in row)) for row in zip(*(part.column(c) for c in columns), strict=True)]
                    joined = {name: np.concatenate([m[name] for m in made]) for name in made[0]}
                    yield finish(_rows(part.column("doc_id"), joined, np.array([len(next(iter(m.values()))) for m in made])))

        return frame.select("doc_id", *columns).mapInArrow(run, other or f"doc_id long, {schema}, part int")

    return rows


def _triples(s: np.ndarray) -> dict[str, np.ndarray]:
    one, two = _samples(len(s))
    at = np.concatenate([one, two])
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    return {
        "i": np.arange(len(at)), "cls": np.zeros(len(at), np.int32), "base": np.ones(len(at), np.int64),
        "c0": padded[at], "c1": padded[at + 1], "c2": padded[at + 2],
    }


def _spread(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Ranks of the sampled places at their places; 0 elsewhere and behind the end."""
    one, two = _samples(len(s))
    out = np.zeros(len(s) + 4, np.int64)
    out[np.concatenate([one, two])] = r
    return out


def _first_merge(s: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Places 0 and 1 modulo 3 by their symbol and the rank behind it."""
    ranks, n = _spread(s, r), len(s)
    at = np.concatenate([np.arange(0, n, 3), np.arange(1, n, 3)])
    cls = (at % 3).astype(np.int32)
    return {"i": at, "cls": cls, "base": np.where(cls == 1, ranks[at], 1), "c0": s[at], "c1": ranks[at + 1]}


def _second_merge(s: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Places 0 and 2 modulo 3 by two symbols and the rank behind them."""
    ranks, n = _spread(s, r), len(s)
    at = np.concatenate([np.arange(0, n, 3), np.arange(2, n, 3)])
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    cls = (at % 3 == 2).astype(np.int32)
    return {"i": at, "cls": cls, "base": np.where(cls == 1, ranks[at], 0), "c0": s[at], "c1": padded[at + 1], "c2": ranks[at + 2]}


def suffix_ranks(strings: DataFrame, levels: int) -> DataFrame:
    """``doc_id, r``: for every place of the strings ``doc_id, s`` the rank of the suffix that starts there.

    Symbols are positive; 0 ends or separates. Suffixes that agree in ``3 ** levels`` symbols may
    share a rank. All strings are sorted together.
    """
    mark = scratch_mark(strings.sparkSession)
    frame = materialized(strings.select("doc_id", "s", F.size("s").alias("n")), "strings")
    if levels == 0:
        return frame.select("doc_id", F.col("s").alias("r"))
    rows = _exploded(["s"], _triples, "i long, cls int, base long, c0 long, c1 long, c2 long")
    names = less_counts(frame, rows, ["c0", "c1", "c2"], own=True)
    sampled = _gathered(names, frame, lambda n: sum(map(len, _samples(n))))
    deeper = suffix_ranks(sampled.withColumnRenamed("r", "s"), levels - 1)
    # samples that stand for no place come before all others and must not count in the ranks
    extra = frame.where("n % 3 = 1").count()
    both = frame.join(deeper, "doc_id").withColumn("r", F.transform("r", lambda x: x - extra))
    both = materialized(both, "ranks")
    first = _exploded(["s", "r"], _first_merge, "i long, cls int, base long, c0 long, c1 long")
    second = _exploded(["s", "r"], _second_merge, "i long, cls int, base long, c0 long, c1 long, c2 long")
    merged_rows = less_counts(both, first, ["c0", "c1"], own=True).union(less_counts(both, second, ["c0", "c1", "c2"], own=False))
    return materialized(_gathered(merged_rows, frame, lambda n: n), "ranks", since=mark)


# --- repeats ---


def _work_rows(work: DataFrame, sizes: Sizes, make: Callable, schema: str, extra: list[str] | None = None) -> DataFrame:
    """Record batches that ``make`` builds from the blocks of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            for i in range(batch.num_rows):
                blocks = blocks_of(batch.column("data")[i].as_buffer(), _pairs(lists, i), sizes)
                yield make(batch.column("doc_id")[i].as_py(), blocks, *(batch.column(c)[i] for c in extra or []))

    return work.select("doc_id", "data", "spans", *(extra or [])).mapInArrow(run, schema)


def block_names(work: DataFrame, sizes: Sizes) -> tuple[DataFrame, int]:
    """``doc_id, s``: block names of each document in byte order; and the levels that cover a repeat."""

    def rows(doc_id: int, b: Blocks) -> pa.RecordBatch:
        data = b.data.tobytes()
        stop = np.minimum(b.x + sizes.block, b.ends)
        n = len(b.x)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, doc_id, np.int64)), pa.array(b.index), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int64)),
                pa.array([data[p:q] for p, q in zip(b.x.tolist(), stop.tolist(), strict=True)], pa.binary()),
            ],
            names=["doc_id", "i", "cls", "base", "block"],
        )

    def size(doc_id: int, b: Blocks) -> pa.RecordBatch:
        near = np.searchsorted(b.x, b.x + sizes.length) - np.arange(len(b.x))
        most = int(near.max()) if len(near) else 0
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_id], pa.int64()), pa.array([b.count], pa.int32()), pa.array([most], pa.int32())], names=["doc_id", "n", "most"]
        )

    frame = materialized(_work_rows(work, sizes, size, "doc_id long, n int, most int"), "sizes")

    def named(some: DataFrame, finish: Callable, other: str | None) -> DataFrame:
        schema = other or "doc_id long, i long, cls int, base long, block binary, part int"
        return _work_rows(some, sizes, lambda doc_id, b: finish(rows(doc_id, b)), schema)

    names = less_counts(work, named, ["block"], own=True, width=sizes.block)
    strings = _gathered(names, frame, lambda n: n).withColumnRenamed("r", "s")
    most, levels = frame.agg(F.max("most")).first()[0] or 0, 0
    while 3**levels < most:
        levels += 1
    return strings, levels


def _neighbours(anchors: DataFrame, sizes: Sizes) -> DataFrame:
    """Sort anchors by suffix and compare each with the two beside it.

    Adds ``settled`` (a neighbour has the same whole context) and ``far``, the smallest distance
    at which a string can begin before the anchor. The first and the last row of a task have a
    neighbour elsewhere; they stay open, which the last step copes with.
    """
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["r", "whole", "doc_id", "x"]
    dealt = anchors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    steps = sizes.ladder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if rows.num_rows > 2:
                yield from judged(rows, first, False)
                first = False
                held = rows.slice(rows.num_rows - 2)
            else:
                held = rows
        if held is not None:
            yield from judged(held, first, True)

    def judged(rows: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        ladder = rows["ladder"].combine_chunks().flatten().to_numpy().reshape(n, len(steps))
        whole = rows["whole"].to_numpy()
        # a chance match of 32 bits opens places too many, never too few
        # prefixes get shorter along the ladder; beyond the step before the first equal one a string can begin
        equal = np.concatenate([ladder[1:] == ladder[:-1], np.ones((n - 1, 1), bool)], axis=1)
        reach = np.array([0, *(d + 1 for d in steps[:-1]), np.iinfo(np.int32).max])[equal.argmax(axis=1)]
        far = np.full(n, np.iinfo(np.int32).max, np.int64)
        far[1:] = reach
        far[:-1] = np.minimum(far[:-1], reach)
        settled = np.zeros(n, bool)
        settled[1:] = whole[1:] == whole[:-1]
        leads = ~settled
        settled[:-1] |= whole[1:] == whole[:-1]
        begin, stop = 0 if first else 1, n if last else n - 1
        if first:
            far[0] = 0
        if last:
            far[-1] = 0
        made = rows.select(["doc_id", "x", "lo", "hi", "core"])
        made = made.append_column("far", pa.array(far)).append_column("settled", pa.array(settled)).append_column("leads", pa.array(leads))
        yield from made.slice(begin, stop - begin).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "doc_id long, x long, lo long, hi long, core long, far long, settled boolean, leads boolean")


def repeated_spans(work: DataFrame, sizes: Sizes) -> DataFrame:
    """``doc_id, start, stop`` of the places ``[start, stop)`` at which repeated strings begin."""
    mark = scratch_mark(work.sparkSession)
    strings, levels = block_names(work, sizes)
    ranks = materialized(suffix_ranks(strings, levels), "ranks", since=mark)
    steps = np.array(sizes.ladder)

    def anchors(doc_id: int, b: Blocks, r: pa.Scalar) -> pa.RecordBatch:
        ranks = r.values.to_numpy()[b.index] if len(b.x) else np.empty(0, np.int64)
        stops = b.x[:, None] + sizes.length - steps[None, :]
        inside = stops <= b.ends[:, None]
        at = np.broadcast_to(b.x[:, None], stops.shape)
        ladder = b.ranges(at.ravel(), np.minimum(stops, b.ends[:, None]).ravel()).reshape(stops.shape)
        # prefixes that would leave the region are like no other
        alone = chain(np.uint64(doc_id & (2**64 - 1)) + np.zeros_like(ladder), (b.x[:, None] + b.shift[:, None]).astype(np.uint64) + np.zeros_like(ladder))
        ladder = np.where(inside, ladder, chain(alone, np.arange(len(steps), dtype=np.uint64)[None, :] + alone))
        use = b.hi >= b.lo
        whole = chain(b.ranges(b.lo[use], b.hi[use] + sizes.length), chain((b.x - b.lo)[use].astype(np.uint64), (b.hi - b.lo)[use].astype(np.uint64)))
        n = int(use.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, doc_id, np.int64)), pa.array(b.x[use] + b.shift[use]), pa.array(b.lo[use] + b.shift[use]),
                pa.array(b.hi[use] + b.shift[use]), pa.array(ranks[use]), pa.array(whole.view(np.int64)),
                pa.array(ladder[use, -1].view(np.int64)),
                _long_lists((ladder[use].ravel() & _LOW).astype(np.uint32).view(np.int32), np.arange(n + 1) * len(steps), np.int32),
            ],
            names=["doc_id", "x", "lo", "hi", "r", "whole", "core", "ladder"],
        )

    ranked = work.join(ranks, "doc_id")
    schema = "doc_id long, x long, lo long, hi long, r long, whole long, core long, ladder array<int>"
    rows = materialized(_work_rows(ranked, sizes, anchors, schema, ["r"]), "anchors")
    judged = materialized(_neighbours(rows, sizes), "neighbours", since=mark)
    settled = judged.where("settled").select("doc_id", F.col("lo").alias("start"), (F.col("hi") + 1).alias("stop"))
    # a string that begins d bytes before the anchor needs length - d common bytes behind it
    near = judged.withColumn("hi", F.least("hi", F.col("x") - F.col("far"))).where("hi >= lo and (not settled or leads)")
    open_cores = near.where("not settled").select("core").distinct()
    near = near.join(open_cores, "core", "left_semi")
    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("x", "lo", "hi", "settled")).alias("places"))
    found = materialized(_place_hashes(work.join(wanted, "doc_id"), sizes), "places")
    single = found.where("bucket is null").select(F.inline("here")).union(_met_places(found.where("bucket is not null")))
    return settled.union(single.select("doc_id", F.col("p").alias("start"), (F.col("p") + 1).alias("stop")))


def _same_strings(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """``order, again, told``: places in the order of their strings; which of them share theirs; at most two of each string."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = new[:-1]
    second = ~first
    second[1:] &= first[:-1]
    return order, ~(first & new[1:]), first | second


_PLACES = "here array<struct<doc_id: long, p: long>>, bucket int, h array<long>, g array<long>, doc_id array<long>, p array<long>"


def _place_hashes(work: DataFrame, sizes: Sizes) -> DataFrame:
    """Each open place is told by its string's hash ``h``, and ``g``, of its anchor and their distance.

    Rows of two kinds: ``here``, the open places whose strings meet another in the same task; and one or two places of
    each string, as lists by ``bucket``, for the other tasks. ``p`` is -1 if a place is settled and only counts.
    """
    k = sizes.dense[0]
    buckets = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, g, doc, p = (np.concatenate(c) for c in zip(*held, strict=True))
        order, again, told = _same_strings(h, g)
        here = order[again]
        here = here[p[here] >= 0]
        some = order[told]
        bucket = (mix(h[some]) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        some, bucket = some[by], bucket[by]
        own, begins = np.unique(bucket, return_index=True)
        begins = np.append(begins, len(some))
        names = ["here", "bucket", "h", "g", "doc_id", "p"]
        lists = [_long_lists(c[some].view(np.int64), begins) for c in (h, g, doc, p)]
        places = pa.StructArray.from_arrays([pa.array(doc[here]), pa.array(p[here])], ["doc_id", "p"])
        own_places = pa.ListArray.from_arrays(pa.array(np.array([0, len(here)], np.int32)), places)
        yield pa.RecordBatch.from_arrays([own_places, pa.nulls(1, pa.int32()), *(pa.nulls(1, c.type) for c in lists)], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), own_places.type), pa.array(own), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
                sums = prefix_hashes(data)
                values = batch.column("places")[i].values
                x, lo, hi = (values.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                settled = values.field(3).to_numpy(zero_copy_only=False).astype(bool)
                counts = hi - lo + 1
                owner = np.repeat(np.arange(len(x)), counts)
                p = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[owner]
                g = chain(range_hashes(sums, x, x + k)[owner], (x[owner] - p).astype(np.uint64))
                own = np.full(len(p), batch.column("doc_id")[i].as_py(), np.int64)
                held.append((range_hashes(sums, p, p + sizes.length), g, own, np.where(settled[owner], -1, p)))
                size += len(p)
                if size >= HELD_ROWS:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    return work.select("doc_id", "data", "places").mapInArrow(run, _PLACES)


def _met_places(lists: DataFrame) -> DataFrame:
    """``doc_id, p`` of the open places whose strings occur in several of the lists."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(c).flatten().to_numpy() for c in ("h", "g", "doc_id", "p")] for batch in batches if batch.num_rows]
        if not held:
            return
        h, g, doc, p = (np.concatenate(c) for c in zip(*held, strict=True))
        order, again, _ = _same_strings(h, g)
        some = order[again]
        some = some[p[some] >= 0]
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(p[part])], names=["doc_id", "p"])

    dealt = lists.select("bucket", "h", "g", "doc_id", "p").repartitionById(parts, F.col("bucket"))
    return dealt.mapInArrow(run, "doc_id long, p long")


# --- removal ---


def _prepared(docs: DataFrame, length: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of each row with ``copied``, the documents to work on, and the places where repeats begin."""
    sizes, mark = Sizes(length), scratch_mark(docs.sparkSession)
    texts = docs.select(
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("data")
    )
    sketch = materialized(sketches(texts, sizes), "sketches")
    classes = sketch.where(F.col("n_bytes") >= length).groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialized(classes, "classes")
    spans = regions(sketch, classes, length).select(F.col("doc_id").alias("rep"), F.col("text_key").alias("key"), "spans")
    # the id goes into the join to keep the copies of a text apart, null ids too
    chosen = texts.withColumn("text_key", text_key(F.col("data")))
    chosen = chosen.join(spans, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    # from here on a distinct text is a document, named by its key
    over = scratch_mark(docs.sparkSession)
    work = materialized(chosen.select(F.col("key").alias("doc_id"), "data", "spans").dropDuplicates(["doc_id"]), "work")
    copied = classes.where("copies > 1").select("text_key", F.lit(True).alias("copied"))
    facts = sketch.where("bucket is null").select("doc_id", "text_key", "n_bytes", "sha").join(copied, "text_key", "left")
    facts = materialized(facts, "facts", since=mark, until=over)
    return facts, work, repeated_spans(work, sizes)


def text_key(data: Column) -> Column:
    """The first 64 bits of the SHA-256 digest, as ``sketches`` has them."""
    return F.conv(F.substring(F.sha2(data, 256), 1, 16), 16, -10).cast("long")


def cut_spans(starts: DataFrame, length: int) -> DataFrame:
    """``doc_id, cuts``: sorted distinct ``[start, stop)`` byte ranges to remove, not yet merged."""
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("stop") + length - 1).alias("stop"))))
    return starts.groupBy("doc_id").agg(spans.alias("cuts"))


def whole_words(data: bytes | memoryview, start: int, stop: int) -> int:
    """Words between white space that lie in ``[start, stop)`` to their ends."""
    around = bytes(data[max(start - 1, 0) : stop + 1])
    inner = around[start - max(start - 1, 0) :][: stop - start]
    begun = start > 0 and not around[:1].isspace() and not inner[:1].isspace()
    open_end = stop < len(data) and not around[-1:].isspace() and not inner[-1:].isspace()
    return len(inner.split()) - begun - open_end


def kept_bytes(data: bytes | memoryview, cuts: np.ndarray, min_words: int = 0) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of runs; runs of fewer words stay."""
    cuts = merged(cuts)
    whole = np.frombuffer(data, np.uint8)
    if min_words:
        cuts = cuts[[whole_words(data, a, b) >= min_words for a, b in cuts.tolist()]]
    keep = np.ones(len(whole) + 1, np.int32)
    keep[:] = 0
    keep[cuts[:, 0]] += 1
    np.add.at(keep, cuts[:, 1], -1)
    left = whole[np.cumsum(keep[:-1]) == 0]
    return left.tobytes(), len(whole) - len(left), len(cuts)


def _cut(work: DataFrame, starts: DataFrame, length: int, min_words: int = 0) -> DataFrame:
    """``doc_id, gone, runs, left``: what is left of the texts that lose something."""
    partial = work.select("doc_id", "data").join(cut_spans(starts, length), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [kept_bytes(part.column("data")[i].as_buffer(), _pairs(part.column("cuts"), i), min_words) for i in range(part.num_rows)]
                columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (0, pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "gone", "runs", "left"])

    return partial.mapInArrow(run, "doc_id long, gone long, runs long, left binary")


def removal_facts(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    mark = scratch_mark(docs.sparkSession)
    sketch, work, starts = _prepared(docs, length, doc_id, text)
    cut = _cut(work, starts, length).select("doc_id", "gone", "runs", F.sha2("left", 256).alias("left_sha"))
    nothing = hashlib.sha256(b"").hexdigest()
    copied = F.coalesce("copied", F.lit(False))
    kind = docs.schema[doc_id].dataType

    def either(all_gone: Column, some: Column, none: Column) -> Column:
        return F.when(copied, all_gone).otherwise(F.coalesce(some, none))

    # rows of copied texts lose all, and would meet under one key
    own = sketch.where("copied is null").join(cut.withColumnRenamed("doc_id", "text_key"), "text_key", "left")
    out = own.unionByName(sketch.where("copied"), allowMissingColumns=True).select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "n_bytes",
        either(F.col("n_bytes"), F.col("gone"), F.lit(0).cast("long")).alias("n_removed"),
        either(F.lit(1).cast("long"), F.col("runs"), F.lit(0).cast("long")).alias("n_spans"),
        either(F.lit(nothing), F.col("left_sha"), F.col("sha")).alias("kept_sha256"),
    )
    return materialized(out, "removed", since=mark)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [left.as_py().decode("utf-8", "ignore") for left in batch.column("left")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "_left"])


def repeats_removed(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", min_words: int = 0
) -> DataFrame:
    """``docs`` with every text cut; bytes of characters that a cut went through go too. No row is dropped."""
    mark = scratch_mark(docs.sparkSession)
    sketch, work, starts = _prepared(docs, length, doc_id, text)
    cut = _cut(work, starts, length, min_words).select("doc_id", "left").mapInArrow(_decoded, "doc_id long, _left string")
    gone = sketch.where("copied").select("doc_id", "text_key", F.lit("").alias("_left"), F.lit(True).alias("_whole"))
    # texts without copies: one row each
    single = sketch.where("copied is null").select("doc_id", "text_key")
    some = single.join(cut.withColumnRenamed("doc_id", "text_key"), "text_key").select("doc_id", "text_key", "_left", F.lit(False).alias("_whole"))
    new = gone.unionByName(some).select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), "_left", "_whole")
    new = materialized(new.dropDuplicates(["_cut_id", "_cut_key"]), "cut", since=mark)
    own_key = text_key(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))
    joined = docs.withColumn("_own_key", own_key).join(
        new, (F.col("_own_key") == F.col("_cut_key")) & F.col(f"`{doc_id}`").cast("string").eqNullSafe(F.col("_cut_id")), "left"
    )
    words = F.size(F.filter(F.split(F.col(f"`{text}`"), BREAKS), lambda w: w != ""))
    short = F.col("_whole") & (words < min_words)
    value = F.when(F.col("_left").isNotNull() & ~short, F.col("_left")).otherwise(F.col(f"`{text}`"))
    return joined.withColumn(text, value).select(*(f"`{c}`" for c in docs.columns))

"""Near-duplicate groups by b-bit MinHash.

A text is the set of its distinct word shingles. ``MINIMA`` hash minima per set make ``BANDS``
keys of ``ROWS`` minima each; of every minimum only the ``BITS`` low bits are kept, packed into
longs. Sets that share a band key are candidates; their similarity is estimated from the bit
counts of the packed signatures, corrected for equal bits by chance, and candidates above
``threshold`` less ``MARGIN`` (four and a half standard errors) are confirmed on the full sets.

Large buckets are not expanded into pairs. Equal sets are one class from the start. In each
round a bucket compares its members with one pivot only, the member that shares most keys;
confirmed links are joined into components. Last, members outside a bucket's largest component
meet that component and each other, so no link between components is left out: in blocks of
sets that give out only links that join something (small largest components by a join).

Defined cases: a null text or one without words has the empty set and is linked with nothing;
a text with fewer words than a shingle has its whole word sequence as one shingle; rows with
a null id are linked with nothing and have a null component. A row that is repeated as a whole
is one document: both rows have the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected
from lectern.llm.words import mix, shingles, word_slices
from lectern.session import materialized, scratch_mark

# Bands of seven rows, so that sets which share a common line only seldom share a key.
MINIMA, BANDS, ROWS, BITS = 448, 64, 7, 4
LONGS = MINIMA * BITS // 64
MARGIN = 0.09
STAR_ROUNDS = 2
# Members of a component that are joined one by one; beyond that, shingles in a block of its sets.
FEW = 16
BLOCK = 500_000
ROWS_AT_ONCE = 2_000
_random = np.random.default_rng(71)
_FACTOR = _random.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def sets(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes sorted by text, and where each text's set begins (``n + 1`` offsets)."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(n + 1))


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``MINIMA`` 32-bit minima of each non-empty set (rows of empty sets are zero)."""
    out = np.zeros((len(begins) - 1, MINIMA), np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[:-1][full]
        for k in range(MINIMA):
            out[full, k] = np.minimum.reduceat(hashes * _FACTOR[k] + _SHIFT[k] >> np.uint64(32), at)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    wide = minima[:, : BANDS * ROWS].reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
    return key.view(np.int64)


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """The low bits of all minima in ``LONGS`` longs."""
    per = 64 // BITS
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), LONGS, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def signed(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, low, high, bits, keys``: set size, two sums that tell sets apart, signature and band keys."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in word_slices(batch.column(1)):
                hashes, begins = sets(*shingles(words, shingle), stop - start)
                minima = signatures(hashes, begins)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (hashes, mix(hashes * np.uint64(3)))]
                low, high = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start), pa.array(np.diff(begins)), pa.array(low), pa.array(high),
                        _lists(packed_bits(minima)), _lists(band_keys(minima)),
                    ],
                    names=["doc_id", "n", "low", "high", "bits", "keys"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, low long, high long, bits array<long>, keys array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, members`` (sorted distinct shingle hashes) of rows ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in word_slices(batch.column(1)):
                hashes, begins = sets(*shingles(words, shingle), stop - start)
                members = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), members], names=["doc_id", "members"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, members array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the bit counts of two packed signatures, corrected for chance."""
    ones = int("1" * 16, 16)

    def different(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        halved = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(halved.bitwiseOR(F.shiftrightunsigned(halved, 2)).bitwiseAND(F.lit(ones)))

    apart = F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return ((1 - apart / MINIMA) - chance) / (1 - chance)


def _bits_apart(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many minima the packed signatures of ``rows`` differ from ``one``."""
    d = rows ^ one
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(int("1" * 16, 16))).sum(axis=1)


def _most_apart(percent: int) -> float:
    """Differing minima up to which two sets may be alike."""
    chance = 1 / (1 << BITS)
    return MINIMA * (1 - ((percent / 100 - MARGIN) * (1 - chance) + chance))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted as unsigned numbers, are alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def alike_blocks(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each row ``rep, bits, members`` of ``left`` a pair ``(a, b)`` with a row of ``right`` whose full set is alike.

    All of ``right`` is one component, so the first such row is enough.
    """
    x, y = (np.stack(df["bits"].to_numpy()).view(np.uint64) for df in (left, right))
    ids, sets_y, most = right["rep"].to_numpy(), right["members"].to_numpy(), _most_apart(percent)
    found = []
    for row, own, one in zip(left["rep"].to_numpy(), left["members"], x, strict=True):
        for k in np.flatnonzero(_bits_apart(y, one) <= most):
            if _alike(own.view(np.uint64), sets_y[k].view(np.uint64), percent):
                found.append((min(row, ids[k]), max(row, ids[k])))
                break
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def cell_links(cell: pa.Table, percent: int) -> pa.Table:
    """Links ``a, b`` between components among the rows ``p, q, place, rep, component, n, bits, members`` of a cell.

    Links that join what earlier links of the cell have joined are left out, so there are fewer
    links than rows. In a cell of two places, only rows of different places are compared.
    """
    cell = cell.sort_by("n").combine_chunks()
    rep, own, n, place = (cell[c].to_numpy() for c in ("rep", "component", "n", "place"))
    bits = cell["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), LONGS)
    members = cell["members"].combine_chunks()
    values, begins = members.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
    two, own, most = cell["p"][0].as_py() != cell["q"][0].as_py(), own.copy(), _most_apart(percent)
    stops = np.searchsorted(n, 100 * n // percent, "right")
    found = []
    for i in range(len(rep)):
        others = np.arange(i + 1, stops[i])
        others = others[(own[others] != own[i]) & ((place[others] != place[i]) | (not two))]
        others = others[_bits_apart(bits[others], bits[i]) <= most]
        for j in others:
            if own[j] != own[i] and _alike(values[begins[i] : begins[i + 1]], values[begins[j] : begins[j + 1]], percent):
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                own[own == own[j]] = own[i]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class _Groups:
    """The distinct sets that share a key, their buckets, and the components found so far."""

    def __init__(self, docs: DataFrame, sketch: DataFrame, classes: DataFrame, shingle: int, percent: int):
        self.percent = percent
        own = F.xxhash64("n", "low", "high")
        exploded = sketch.where("n > 0 and doc_id is not null").select(own.alias("cls"), F.explode("keys").alias("key"))
        shared = exploded.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("key")
        met = exploded.join(shared, "key").distinct()
        met = materialized(met.join(classes.select(own.alias("cls"), "rep"), "cls").select("key", "rep"), "buckets")
        sizes = met.groupBy("key").agg(F.count("*").alias("m"))
        degree = met.join(sizes, "key").groupBy("rep").agg(F.sum("m").alias("degree"))
        degree = materialized(degree, "degrees")
        self.buckets = materialized(met.join(degree, "rep"), "buckets")
        self.parts = degree.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
        wanted = degree.select(F.col("rep").alias("doc_id"))
        signs = sketch.select("doc_id", "n", "bits").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        self.signs = materialized(signs.withColumnRenamed("doc_id", "rep"), "signatures")
        # one plan at every size: the texts are dealt by id, once
        texts = docs.join(wanted.hint("merge"), "doc_id", "left_semi")
        self.members = materialized(full_sets(texts, shingle), "members")

    def _labelled(self) -> DataFrame:
        """Members of the buckets that hold two components or more, with what is largest in them."""
        label = self.parts.select(F.col("node").alias("rep"), "component")
        rows = self.buckets.join(label, "rep")
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        most = sizes.groupBy("key").agg(
            F.max(F.struct("c", (-F.col("component")).alias("x"))).alias("top"), F.count("*").alias("components"),
            F.sum("c").alias("members"),
        )
        most = most.where("components > 1").select("key", "members", F.when(F.col("top.c") > 1, -F.col("top.x")).alias("largest"))
        rows = rows.join(most, "key")
        return rows.withColumn("main", F.coalesce(F.col("component") == F.col("largest"), F.lit(False))).drop("largest")

    def star_pairs(self) -> DataFrame:
        """Each member outside its bucket's largest component, with the pivot of those members."""
        rows = self._labelled().where("not main").select("key", "rep", "degree", "component")
        best = F.max(F.struct("degree", (-F.col("rep")).alias("x"), "component")).alias("best")
        pivot = rows.groupBy("key").agg(best).select("key", (-F.col("best.x")).alias("pivot"), F.col("best.component").alias("of"))
        pairs = rows.join(pivot, "key").where("component <> of")
        return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()

    def cross_links(self) -> DataFrame:
        """Links of members outside their bucket's largest component with the other components of the bucket."""
        # of a bucket of two, the first round has compared all there is
        rows = self._labelled().where("members > 2").select("key", "rep", "component", "main")
        rows = materialized(rows, "cross")
        left = rows.where("not main").select("key", F.col("rep").alias("x"))
        largest = rows.where("main").select("key", "component").distinct()
        meets = left.join(largest, "key").select("x", "component").distinct()
        size = self.parts.groupBy("component").agg(F.count("*").alias("size"))
        meets = materialized(meets.join(size, "component"), "meets")
        few = meets.where(F.col("size") <= FEW).join(self.parts, "component").select(F.col("x"), F.col("node").alias("y"))
        pairs = few.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = self.confirm(pairs).union(materialized(self._blocks(meets.where(F.col("size") > FEW)), "confirmed"))
        return links.union(materialized(self._cells(rows.where("not main").drop("main")), "confirmed"))

    def _cells(self, rows: DataFrame) -> DataFrame:
        """Links among the members ``key, rep, component`` of a bucket, its largest component aside.

        A bucket is dealt into places of about ``BLOCK`` shingles and at most about ``ROWS_AT_ONCE``
        rows, and every two places meet in a cell, which gives out links only.
        """
        signs = self.signs.join(self.members.withColumnRenamed("doc_id", "rep"), "rep")
        held = rows.join(self.signs.select("rep", "n"), "rep").groupBy("key")
        places = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / ROWS_AT_ONCE)).cast("int").alias("places")
        sizes = held.agg(places, F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "places")
        dealt = rows.join(sizes, "key").withColumn("place", F.pmod(F.xxhash64("rep"), "places").cast("int"))
        dealt = dealt.join(signs, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
        dealt = dealt.select(
            "key", F.least("place", "other").alias("p"), F.greatest("place", "other").alias("q"),
            "place", "rep", "component", "n", "bits", "members",
        )
        percent = self.percent

        def compare(cell: pa.Table) -> pa.Table:
            return cell_links(cell, percent)

        return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long").distinct()

    def _blocks(self, meets: DataFrame) -> DataFrame:
        """Links of members ``x`` with members of large components.

        Both sides are dealt into blocks of about ``BLOCK`` shingles, and each block of the one
        meets each of the other; a task gives out one link per member and block.
        """
        signs = self.signs.join(self.members.withColumnRenamed("doc_id", "rep"), "rep")
        x = meets.select("component", F.col("x").alias("rep")).join(signs, "rep")
        large = meets.select("component").distinct()
        y = self.parts.select("component", F.col("node").alias("rep")).join(large, "component", "left_semi").join(signs, "rep")
        cut = F.ceil(F.sum("n") / BLOCK).cast("int")
        sizes = x.groupBy("component").agg(cut.alias("nx")).join(y.groupBy("component").agg(cut.alias("ny")), "component")
        place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # both sides come from the same tables: new names for one of them
        own = [F.col(c).alias(c) for c in ("rep", "bits", "members")]
        x, y = x.join(sizes, "component"), y.join(sizes, "component")
        x = x.select(F.col("component").alias("component"), place("nx").alias("bx"), every("ny").alias("by"), *own)
        y = y.select("component", every("nx").alias("bx"), place("ny").alias("by"), "rep", "bits", "members")
        percent = self.percent

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
            return alike_blocks(left, right, percent)

        group = ["component", "bx", "by"]
        return x.groupBy(*group).cogroup(y.groupBy(*group)).applyInPandas(compare, "a long, b long")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are alike."""
        for x in ("a", "b"):
            pairs = pairs.join(self.signs.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")), x)
        sized = F.lit(100) * F.least("na", "nb") >= F.lit(self.percent) * F.greatest("na", "nb")
        near = estimate(F.col("bitsa"), F.col("bitsb")) >= self.percent / 100 - MARGIN
        close = materialized(pairs.where(sized & near).select("a", "b", "na", "nb"), "candidates")
        for x in ("a", "b"):
            close = close.join(self.members.select(F.col("doc_id").alias(x), F.col("members").alias(f"set{x}")), x)
        both = F.size(F.array_intersect("seta", "setb"))
        sure = F.lit(100) * both >= F.lit(self.percent) * (F.col("na") + F.col("nb") - both)
        return materialized(close.where(sure).select("a", "b"), "confirmed")

    def link(self, links: DataFrame) -> None:
        """Join the components of confirmed pairs."""
        for x in ("a", "b"):
            links = links.join(self.parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x)
        joined = connected(links.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("into"))
        parts = self.parts.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        self.parts = materialized(parts, "components")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; ``kept`` is the smallest id of a group.

    Two rows are linked if ``100 * |A and B| >= percent * |A or B|`` for their shingle sets.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketch = materialized(signed(docs, shingle, doc_id, text), "sketches")
    rows = sketch.select("doc_id", "n", "low", "high")
    named = rows.where("n > 0 and doc_id is not null")
    classes = materialized(named.groupBy("n", "low", "high").agg(F.min("doc_id").alias("rep")), "classes")
    groups = _Groups(texts.where("doc_id is not null"), sketch, classes, shingle, percent)
    for _ in range(STAR_ROUNDS):
        groups.link(groups.confirm(groups.star_pairs()))
    groups.link(groups.cross_links())
    label = groups.parts.select(F.col("node").alias("rep"), "component")
    owner = classes.join(label, "rep", "left").select("n", "low", "high", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(owner, ["n", "low", "high"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def near_duplicates_removed(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that another document of their group stands for."""
    mark = scratch_mark(docs.sparkSession)
    gone = components(docs, shingle, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    gone = materialized(gone, "gone", since=mark)
    return docs.join(gone, doc_id, "left_anti")

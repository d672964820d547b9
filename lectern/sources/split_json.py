"""Entries of one large JSON object or array, read by as many tasks as the file has splits.

The text reader cuts a file at closing braces, wherever the line ends are, so even a file of one
line has splits. What a split means depends on what stands before it: whether it starts inside
a string, and how deep. A first pass counts quotes and brackets of each split for both cases;
running sums over the splits of a file give every split its state. The second pass cuts entries
out of each split. An entry that lies across splits is put together from the pieces that they
hand out at their ends, one row per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialized

CUT = "}"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]] = 1
_STEP[[0x7D, 0x5D]] = -1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """``(columns that name the split, bytes)`` of runs of rows of one split, the braces back in place."""
    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns - 1)), strict=True))
        values = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        first = 0
        for at in range(1, len(names) + 1):
            if at == len(names) or names[at] != names[first]:
                yield names[first], b"".join([v + b"}" for v in values[first:at]])
                first = at


def _strings(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, escaped ones blanked, and for each whether it stands in a string."""
    plain = np.frombuffer(_ESCAPED.sub(b"  ", text) if b"\\" in text else text, np.uint8)
    return plain, (np.cumsum(plain == 0x22) + inside & 1).astype(bool)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its quotes, and its change of depth if it starts outside or inside a string."""
    found: dict[tuple, list[int]] = {}
    for name, text in _splits(batches):
        own = found.setdefault(name, [0, 0, 0])
        plain, quoted = _strings(text, own[0] & 1)
        steps = _STEP[plain]
        own[1] += int(steps[~quoted].sum())
        own[2] += int(steps[quoted].sum())
        own[0] += int((plain == 0x22).sum())
    rows = [(*name, *own) for name, own in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "quotes", "plain", "quoted"])


class _Split:
    """Cuts the entries of one split as its text comes in."""

    def __init__(self, inside: int, depth: int, level: int):
        self.inside, self.depth, self.level = inside, depth, level
        # pieces of the entry that is open; the first one of a split may have begun before it
        self.open: list[bytes] | None = [] if depth >= level else None
        self.lead: bytes | None = None
        self.seen = False

    def feed(self, text: bytes) -> list[bytes]:
        plain, quoted = _strings(text, self.inside)
        steps = np.where(quoted, 0, _STEP[plain])
        depth = self.depth + np.cumsum(steps, dtype=np.int64)
        comma = (plain == 0x2C) & ~quoted & (depth == self.level)
        opened = (steps == 1) & (depth == self.level)
        closed = (steps == -1) & (depth == self.level - 1)
        entries, before = [], 0
        for at in np.flatnonzero(comma | opened | closed).tolist():
            if self.open is not None:
                whole = b"".join([*self.open, text[before:at]])
                if self.seen:
                    entries.append(whole)
                else:
                    self.lead = whole
            self.seen = True
            self.open = None if closed[at] else []
            before = at + 1
        if self.open is not None:
            self.open.append(text[before:])
        self.inside, self.depth = int(quoted[-1]), int(depth[-1])
        return entries

    def ends(self) -> tuple[bytes | None, bytes | None]:
        """What belongs to an entry begun before the split, and what begins an entry that goes on."""
        rest = None if self.open is None else b"".join(self.open)
        return (self.lead, rest) if self.seen else (rest, None)


def _cutter(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits: dict[tuple, _Split] = {}
        for name, text in _splits(batches):
            path, start, inside, depth = name
            own = splits.setdefault((path, start), _Split(inside, depth, level))
            entries = own.feed(text)
            if entries:
                yield _rows([path] * len(entries), [start] * len(entries), entries, None, None, None)
        for (path, start), own in splits.items():
            lead, tail = own.ends()
            yield _rows([path], [start], [None], [lead], [tail], [own.seen])

    return run


def _rows(path: list, start: list, entry: list, lead: list | None, tail: list | None, seen: list | None) -> pa.RecordBatch:
    n = len(path)
    text = lambda values: pa.array(values or [None] * n, pa.binary()).cast(pa.string())
    columns = [pa.array(path, pa.string()), pa.array(start, pa.int64()), text(entry), text(lead), text(tail), pa.array(seen or [None] * n, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "start", "entry", "lead", "tail", "seen"])


def json_entries(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """``(path, entry)``: the text of every entry ``level`` brackets deep, in no order.

    At level 1 these are the ``"key": value`` pairs of an object, or the elements of an array; at level
    2 those of the containers in it. Several objects in a file, on lines of their own or not, are
    read alike. A table of one row per split of the input goes to all tasks.
    """
    lines = spark.read.option("lineSep", CUT).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    counted = rows.mapInArrow(_summary, "path string, start long, quotes long, plain long, quoted long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int")
    known = counted.withColumn("inside", inside)
    own = F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain"))
    depth = F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int")
    states = materialized(known.withColumn("own", own).withColumn("depth", depth).select("path", "start", "inside", "depth"), "splits")
    placed = rows.join(F.broadcast(states), ["path", "start"]).select("path", "start", "inside", "depth", "value")
    cut = materialized(placed.mapInArrow(_cutter(level), "path string, start long, entry string, lead string, tail string, seen boolean"), "entries")

    ends = cut.where(F.col("seen").isNotNull())
    begun = F.last(F.when(F.col("seen"), F.col("start")), ignorenulls=True).over(before)
    pieces = ends.withColumn("begun", F.coalesce(begun, F.lit(-1).cast("long"))).select(
        "path",
        "start",
        F.explode(
            F.array(
                F.struct(F.col("begun").alias("group"), F.lit(0).alias("part"), F.col("lead").alias("text")),
                F.struct(F.col("start").alias("group"), F.lit(1).alias("part"), F.col("tail").alias("text")),
            )
        ).alias("p"),
    )
    joined = pieces.where("p.text is not null").groupBy("path", "p.group").agg(F.sort_array(F.collect_list(F.struct("start", "p.part", "p.text"))).alias("p"))
    across = joined.select("path", F.array_join("p.text", "").alias("entry"))
    whole = cut.where(F.col("seen").isNull()).select("path", "entry").unionByName(across)
    return whole.where(F.col("entry").rlike(r"\S"))

"""Cost-balanced packing of documents into training sequences of a fixed number of tokens.

A piece of ``n`` tokens costs ``LINEAR * n + n * n``: the linear part of a layer and its
attention, with ``LINEAR`` = 6 x a model width of 768. Every task packs the documents of its
own partition in windows of bounded size, so nothing is shuffled and no group grows with the
table. In a window, whole sequences are cut off the front of documents that hold some; what is
left goes, longest first, to the sequence of the lowest cost that has room for it. Where none
has, the sequence of the lowest cost with any room is filled and the rest of the piece queues
again. The rooms of a window add up to its tokens: full sequences, and for the remainder one
sequence for each power of two in it. So a sequence is full or has a power of two of tokens,
and none is padded.

Token ids are those that the tokenizers library gives for the whole text, its special tokens
being ordinary text.

Defined cases: a null or empty text has the end id only; rows with null or repeated ids are
documents of their own; equal lengths are taken in the order of the rows; an empty table has
no pieces; columns of the input with names of the output are replaced. A very long text is
one row, so a task holds its ids at once.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR = 6 * 768
CAPACITY = 1024
#: A window ends with the document that reaches one of these.
WINDOW_DOCS = 8192
WINDOW_TOKENS = 1 << 22
ROWS_OUT = 4096
#: Fixed value: the splitting pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{1000}")
_loaded: dict[str, Coder] = {}


def cost(n: int | np.ndarray) -> int | np.ndarray:
    """Estimated cost of a piece of ``n`` tokens."""
    return LINEAR * n + n * n


class Coder:
    """Ids of whole texts as little-endian 32-bit numbers, as the tokenizer file gives them.

    The merges of a byte-level BPE file are taken over by tiktoken, which is several times
    faster. Its pattern engine cannot pass very long white space; texts that have it go
    through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = set(self.tokenizer.get_added_tokens_decoder())
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in self.tokenizer.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def byte_characters() -> list[str]:
    """The character that a byte-level BPE file writes for each byte: itself if visible in Latin-1, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in visible)}
    return [others.get(b, chr(b)) for b in range(256)]


def coder(path: str) -> Coder:
    """One coder per worker process."""
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def rooms(tokens: int, capacity: int) -> np.ndarray:
    """Sizes of sequences that hold exactly so many tokens: full ones and powers of two."""
    rest = tokens % capacity
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([capacity] * (tokens // capacity) + powers, np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Pieces of a window of documents: rows ``(document, start, length, sequence, offset)``."""
    lengths = np.asarray(lengths, np.int64)
    whole = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.stack([doc, number * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc))], 1)
    left = lengths - whole * capacity
    size = rooms(int(left.sum()), capacity)
    room, costs = size.copy(), np.zeros(len(size), np.int64)
    queue = [(-int(n), int(d), int(whole[d]) * capacity) for d, n in enumerate(left) if n]
    heapq.heapify(queue)
    never, pieces = np.iinfo(np.int64).max, []
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        s = int(np.where(room >= n, costs, never).argmin())
        if room[s] < n:
            s = int(np.where(room > 0, costs, never).argmin())
        taken = min(n, int(room[s]))
        pieces.append((d, start, taken, len(full) + s, int(size[s] - room[s])))
        room[s] -= taken
        costs[s] += cost(taken)
        if taken < n:
            heapq.heappush(queue, (taken - n, d, start + taken))
    return np.concatenate([full, np.array(pieces, np.int64).reshape(-1, 5)]).astype(np.int64)


class _Window:
    """Documents that a task packs together."""

    def __init__(self) -> None:
        self.kept: list[pa.RecordBatch] = []
        self.ids: list[bytes] = []
        self.tokens = 0

    def pieces(self, capacity: int, first: int, with_ids: bool) -> tuple[int, Iterator[pa.RecordBatch]]:
        """The number of sequences, and the rows in their order."""
        lengths = np.array([len(x) // 4 for x in self.ids], np.int64)
        doc, start, length, sequence, offset = assign(lengths, capacity).T
        order = np.lexsort((offset, sequence))
        return int(sequence.max()) + 1, self._rows(order, doc, start, length, sequence + first, offset, lengths, with_ids)

    def _rows(self, order, doc, start, length, sequence, offset, lengths, with_ids: bool) -> Iterator[pa.RecordBatch]:
        kept = pa.Table.from_batches(self.kept).combine_chunks()
        for at in range(0, len(order), ROWS_OUT):
            own = order[at : at + ROWS_OUT]
            ids = [self.ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc[own].tolist(), start[own].tolist(), length[own].tolist(), strict=True)]
            columns = kept.take(pa.array(doc[own])).combine_chunks().columns
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            made = [start[own], length[own], np.fromiter(map(zlib.crc32, ids), np.int64, len(ids)), lengths[doc[own]], sequence[own], offset[own]]
            columns += [pa.array(x, pa.int64()) for x in made]
            names = [*kept.schema.names, *PIECE]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length[own])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


#: Columns of a piece, all BIGINT.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """One row per piece of a document: ``keep`` columns (default all), ``PIECE`` and the piece's ``ids``.

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its
    sequence. A sequence's number is made of the partition's and its own within it, so the
    same files give the same sequences when a task runs again.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (*PIECE, "ids")]
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{c} long" for c in PIECE]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = coder(tokenizer_path), TaskContext.get().partitionId() << 33
        window = _Window()
        for batch in batches:
            kept, texts = batch.select(batch.schema.names[:-1]), batch.column(batch.num_columns - 1)
            mark = 0
            for at, value in enumerate(texts, 1):
                ids = own.encode(value.as_py() or "") + end
                window.ids.append(ids)
                window.tokens += len(ids) // 4
                if len(window.ids) >= WINDOW_DOCS or window.tokens >= WINDOW_TOKENS:
                    window.kept.append(kept.slice(mark, at - mark))
                    n, made = window.pieces(capacity, first, with_ids)
                    yield from made
                    first, window, mark = first + n, _Window(), at
            if mark < len(texts):
                window.kept.append(kept.slice(mark))
        if window.ids:
            yield from window.pieces(capacity, first, with_ids)[1]

    return rows.mapInArrow(run, ", ".join([*fields, *(["ids array<int>"] if with_ids else [])]))


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows ``(sequence_id, ids, lengths, cost)``: the pieces of each sequence put together, and how long each is.

    A sequence has at most ``capacity`` pieces, so no group is larger.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"] * LINEAR + x["length"] * x["length"])
    return grouped.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"), total.alias("cost"))

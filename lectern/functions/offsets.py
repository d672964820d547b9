"""Tokens with character offsets, for whole Arrow batches at a time.

Lists are worked on as flat values with the places where rows begin, so there is no Python object per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType().add("token", T.StringType()).add("s", T.IntegerType()).add("e", T.IntegerType()))
# Arrays over the bytes of texts are made for about as many bytes at a time.
BYTES_AT_ONCE = 1 << 20


def ends_of(column: pa.Array) -> np.ndarray:
    """Where the values of each row begin and end: one number more than rows, of lists, strings or binaries."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.offsets.to_numpy().astype(np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def places(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...`` for each row, ``count`` numbers long, after one another."""
    before = np.cumsum(counts) - counts
    return np.repeat(begins - before, counts) + np.arange(counts.sum())


def list_of(values: pa.Array, counts: np.ndarray, null: pa.Array) -> pa.Array:
    """Lists of ``counts`` values each, null where ``null`` says so."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=null)


def _entries(tokens: pa.Array, s: np.ndarray, e: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([tokens, pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["token", "s", "e"])


def space_spans(texts: pa.Array) -> pa.Array:
    """The parts of each text between single spaces, empty ones too; a null text has null tokens."""
    parts = list(space_span_parts(texts))
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def space_span_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The same for some texts at a time: the tokens of a batch are several times as large as its texts."""
    for a, b in _slices(np.diff(ends_of(texts))):
        yield _space_spans(texts.slice(a, b - a))
    if not len(texts):
        yield _space_spans(texts)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``BYTES_AT_ONCE`` bytes; a larger row is one of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + BYTES_AT_ONCE, "right")))
        yield start, stop
        start = stop


def _space_spans(texts: pa.Array) -> pa.Array:
    null = texts.is_null()
    texts = texts.fill_null("")
    at = ends_of(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    begins = at - at[0]
    space = data == 32
    spaces = np.flatnonzero(space)
    counts = np.diff(np.searchsorted(spaces, begins)) + 1
    counts = np.where(null.to_numpy(zero_copy_only=False), 0, counts)
    last = np.cumsum(counts)
    has = counts > 0
    starts, ends = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    inner = np.ones(len(starts), bool)
    inner[(last - counts)[has]] = False
    starts[~inner], starts[inner] = begins[:-1][has], spaces + 1
    inner = np.ones(len(ends), bool)
    inner[last[has] - 1] = False
    ends[~inner], ends[inner] = begins[1:][has], spaces
    # characters before each byte: bytes that continue a character do not count
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = np.repeat(before[begins[:-1]], counts)
    token_ends = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(token_ends), pa.py_buffer(data[~space]))
    return list_of(_entries(tokens, before[starts] - first, before[ends] - first), counts, null)


def spans_after_gaps(tokens: pa.Array, gaps: pa.Array) -> pa.Array:
    """Offsets of tokens from the number of characters before each; further gaps, behind the last token, are not used."""
    null = tokens.is_null()
    missing = null.to_numpy(zero_copy_only=False)
    at, gap_at = ends_of(tokens), ends_of(gaps)
    counts = np.where(missing, 0, np.diff(at))
    own = tokens.values.take(pa.array(places(at[:-1], counts)))
    lengths = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    steps = lengths + gaps.values.take(pa.array(places(gap_at[:-1], counts))).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(steps)])
    begins = np.cumsum(counts) - counts
    ends = sums[1:] - np.repeat(sums[begins], counts)
    return list_of(_entries(own, ends - lengths, ends), counts, null)

"""Words of a batch of texts as numpy arrays: offsets and 64-bit hashes, without a Python loop.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; A-Z are lower-cased.
Texts are handled in slices of about ``SLICE`` bytes, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums from which the hash of any byte range follows (see ``range_hashes``)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``[start, stop)``: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


@dataclass
class Words:
    """Words of the texts of one slice; those of text ``i`` are ``[of[i], of[i + 1])``."""

    hashes: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    data: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts between consecutive ``offsets`` of ``data``."""
    base = offsets[0]
    own = data[base : offsets[-1]]
    if lower:
        own = _LOWER[own]
    offsets = offsets - base
    n = len(own)
    solid = ~_SPACE[own]
    first = np.ones(n, bool)
    first[1:] = ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = ~solid[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    stops = np.flatnonzero(solid & last) + 1
    hashes = range_hashes(prefix_hashes(own), starts, stops)
    return Words(hashes, np.searchsorted(starts, offsets), starts, stops, own)


def word_slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """``(first row, row after the last, words)`` for each slice of a string column."""
    data, offsets = flat(column)
    for start, stop in slices(offsets):
        yield start, stop, words_of(data, offsets[start : stop + 1])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the ``n``-word runs; a text with fewer words has all of them as one run."""
    counts = np.diff(words.of)
    h = words.hashes
    runs = h.copy()
    for k in range(1, n):
        shifted = np.zeros_like(h)
        shifted[:-k or None] = h[k:] if k else h
        runs = chain(runs, shifted)
    text = words.text_of_word()
    place = np.arange(len(h)) - words.of[:-1][text] if len(h) else np.empty(0, np.int64)
    whole = place + n <= counts[text] if len(h) else np.empty(0, bool)
    texts, hashes = [text[whole]], [runs[whole]]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            at = words.of[:-1][short]
            run = h[at]
            for k in range(1, size):
                run = chain(run, h[at + k])
            texts.append(short)
            hashes.append(mix(run + np.uint64(size)))
    return np.concatenate(texts), np.concatenate(hashes)

"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of a batch are bucketed by length into padded matrices of token ids. In each
round every row merges its leftmost pair of the lowest rank; pairs are looked up in an
open-addressing hash table; a merged row closes its gap, finished rows leave the matrix.
Pieces longer than ``LONG`` bytes go through a heap of pairs instead, which gives the same
merges without a quadratic number of steps.

Defined cases: a null or empty text has no tokens; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 512
#: Bytes of a generation of known pieces, what an entry costs beside its characters, and the longest piece that is kept.
CACHE_BYTES = 1 << 24
ENTRY = 200
KEPT = 256
#: Characters of texts whose tokens a task holds at a time.
CHARS_AT_ONCE = 1 << 20
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, LONG)
ROWS = 1 << 15
NEVER = np.int32(np.iinfo(np.int32).max)
_loaded: dict[tuple[str, str], BytePairs] = {}


class PairTable:
    """``(left id, right id) -> rank`` in a hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.mask = np.uint64(size - 1)
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NEVER, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            at = todo[free]
            self.keys[slot[at]] = key[at]
            won = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged tokens, ``NEVER`` where the pair has none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NEVER)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Recent:
    """A bounded cache of two generations: what is used again survives, the rest goes."""

    def __init__(self) -> None:
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0

    def take(self, keys: set[str]) -> dict[str, str]:
        hits = {k: self.young[k] for k in keys & self.young.keys()}
        again = {k: self.old[k] for k in (keys - hits.keys()) & self.old.keys()} if self.old else {}
        self.put(again)
        return hits | again

    def put(self, more: dict[str, str]) -> None:
        more = {k: v for k, v in more.items() if len(k) <= KEPT}
        size = ENTRY * len(more) + sum(map(len, more)) + sum(map(len, more.values()))
        if self.held + size > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        if size <= CACHE_BYTES:
            self.young.update(more)
            self.held += size


class BytePairs:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {str(i): token for token, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the rank file lacks single bytes")
        left, right, rank = [], [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        self.pairs = PairTable(np.array(left, np.int32), np.array(right, np.int32), np.array(rank, np.int32))
        self.names = {i: str(i) for i in self.ranks.values()}
        self.pieces, self.spaced = Recent(), Recent()

    # --- merging ---

    def merge(self, pieces: list[bytes]) -> list[str]:
        """Comma-joined token ids of each piece."""
        out = [self.names.get(self.ranks.get(p), "") for p in pieces]
        todo = [k for k, ids in enumerate(out) if not ids and pieces[k]]
        lengths = np.fromiter((len(pieces[k]) for k in todo), np.int64, len(todo))
        bucket = np.searchsorted(BUCKETS, lengths)
        for b in np.unique(bucket):
            members = np.flatnonzero(bucket == b).tolist()
            if b == len(BUCKETS):
                for m in members:
                    out[todo[m]] = ",".join(map(str, self._merge_long(pieces[todo[m]])))
                continue
            step = max(1, ROWS * 8 // BUCKETS[b])
            for at in range(0, len(members), step):
                some = [todo[m] for m in members[at : at + step]]
                for k, ids in zip(some, self._merge_matrix([pieces[k] for k in some], BUCKETS[b]), strict=True):
                    out[k] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[str]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        columns = np.arange(width)
        ids = np.zeros((n, width), np.int32)
        ids[columns < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        inside = columns[:-1] < (lengths - 1)[:, None]
        ranks = np.full((n, width - 1), NEVER, np.int32)
        ranks[inside] = self.pairs.look_up(ids[:, :-1][inside], ids[:, 1:][inside])
        final, sizes = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), best]
            over = lowest == NEVER
            if over.any():
                final[rows[over], : ids.shape[1]], sizes[rows[over]] = ids[over], lengths[over]
                rows, ids, ranks, lengths, best, lowest = (x[~over] for x in (rows, ids, ranks, lengths, best, lowest))
                if not len(rows):
                    break
            here, wide = np.arange(len(rows)), ids.shape[1]
            ids[here, best] = lowest
            ids = np.where(columns[: wide - 1] > best[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(columns[: wide - 2] > best[:, None], ranks[:, 1:], ranks[:, :-1]) if wide > 2 else ranks
            lengths = lengths - 1
            right = best + 1 < lengths
            ranks[here[right], best[right]] = self.pairs.look_up(ids[here[right], best[right]], ids[here[right], best[right] + 1])
            ranks[here[~right], np.minimum(best[~right], ranks.shape[1] - 1)] = NEVER
            left = best > 0
            ranks[here[left], best[left] - 1] = self.pairs.look_up(ids[here[left], best[left] - 1], ids[here[left], best[left]])
        words = list(map(self.names.__getitem__, final[columns < sizes[:, None]].tolist()))
        ends = np.cumsum(sizes).tolist()
        return [",".join(words[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.look_up(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        at = np.flatnonzero(first != NEVER)
        heap = [(int(r), int(i), ids[i], ids[i + 1]) for r, i in zip(first[at], at, strict=True)]
        heapq.heapify(heap)
        cache: dict[tuple[int, int], int | None] = {}

        def rank(a: int, b: int) -> int | None:
            if (a, b) not in cache:
                r = int(self.pairs.look_up(np.array([a]), np.array([b]))[0])
                cache[a, b] = None if r == NEVER else r
            return cache[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(r, ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return [ids[i] for i in range(n) if alive[i]]

    # --- texts ---

    def encode(self, texts: Iterable[str | None]) -> Iterator[str]:
        """Decimal token ids joined by commas, for each text.

        The pattern never joins a non-space character with a space behind it, so where all
        white space is single spaces and line ends, words with the space before them are split
        and merged once and looked up afterwards. Other texts are split whole.
        """
        for group in _groups(texts):
            plain, whole, heads, tails = [], [], set(), set()
            for t in group:
                words = t.split() if t else []
                if words and " ".join(words) == t.replace("\n", " "):
                    lines = [line.split(" ") for line in t.split("\n")]
                    first = [("\n" if k else "") + line[0] for k, line in enumerate(lines)]
                    heads.update(first)
                    for line in lines:
                        del line[0]
                        tails.update(line)
                    plain.append((first, lines))
                    whole.append(None)
                else:
                    pieces = self.pattern.findall(t) if t else []
                    heads.update(pieces)
                    plain.append(None)
                    whole.append(pieces)
            head = self._all(heads, "", self.pieces)
            tail = self._all(tails, " ", self.spaced)
            for lines, pieces in zip(plain, whole, strict=True):
                if lines is None:
                    yield ",".join(map(head.__getitem__, pieces))
                else:
                    parts = []
                    for first, rest in zip(*lines, strict=True):
                        parts.append(head[first])
                        parts.extend(map(tail.__getitem__, rest))
                    yield ",".join(parts)

    def _all(self, chunks: set[str], before: str, known: Recent) -> dict[str, str]:
        """Ids of ``before + chunk`` for each chunk."""
        found = known.take(chunks)
        new = list(chunks - found.keys()) if len(found) < len(chunks) else []
        if new:
            split = [self.pattern.findall(before + c) for c in new]
            pieces = set().union(*split)
            ids = self.pieces.take(pieces)
            fresh = list(pieces - ids.keys())
            ids = ids | dict(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
            self.pieces.put({p: ids[p] for p in fresh})
            made = {c: ",".join(map(ids.__getitem__, own)) for c, own in zip(new, split, strict=True)}
            if known is not self.pieces:
                known.put(made)
            found = found | made
        return found

    def decode(self, ids: str) -> bytes:
        """Bytes of comma-joined ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def _groups(texts: Iterable[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def coder(ranks_path: str, pattern: str) -> BytePairs:
    """One coder per worker process."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = BytePairs(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def _ints(ids: str) -> list[int]:
    return [int(x) for x in ids.split(",")] if ids else []


def _apply(df: DataFrame, keep: list[str], column: str, schema: str, rows) -> DataFrame:
    """``keep`` columns of each row and what ``rows`` makes of its text, in Arrow batches."""
    kept = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for big in batches:
            for start, stop in _parts(big.column(big.num_columns - 1)):
                batch = big.slice(start, stop - start)
                own = rows(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], *names])
        # the worker stays for other stages, its buffers need not
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, ", ".join([*fields, schema]))


def _parts(column: pa.Array, limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, or of numbers in lists; a larger value is one of its own."""
    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.fill_null(pc.list_value_length(column) if lists else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, ends[start] - sizes[start] + limit, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but ``ids``) and ``ids``, the token ids of the text."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "ids"]

    def rows(texts: pa.Array) -> list[pa.Array]:
        own = coder(ranks_path, pattern)
        return [pa.array([_ints(x) for x in own.encode(x.as_py() for x in texts)], pa.list_(pa.int32()))]

    return _apply(df, keep, text, "ids array<int>", rows)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but ``decoded``) and ``decoded``, the bytes of the ids."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]

    def rows(lists: pa.Array) -> list[pa.Array]:
        own = coder(ranks_path, pattern)
        return [pa.array([own.decode(",".join(map(str, x or []))) for x in lists.to_pylist()], pa.binary())]

    return _apply(df, keep, ids, "decoded binary", rows)


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The ids do not leave the task, so nothing but three small columns is written per text.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]

    def rows(texts: pa.Array) -> list[pa.Array]:
        own = coder(ranks_path, pattern)
        counts, before, after = [], [], []
        for ids in own.encode(x.as_py() for x in texts):
            counts.append(ids.count(",") + 1 if ids else 0)
            before.append(hashlib.sha256(ids.encode()).hexdigest())
            after.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]

    return _apply(df, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def tokens(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids``, ``n_tokens`` and ``decoded_sha256`` (of the decoded ids), in one pass."""
    made = ("ids", "n_tokens", "decoded_sha256")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]

    def rows(texts: pa.Array) -> list[pa.Array]:
        own = coder(ranks_path, pattern)
        lists, after = [], []
        for ids in own.encode(x.as_py() for x in texts):
            lists.append(np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32))
            after.append(hashlib.sha256(own.decode(ids)).hexdigest())
        counts = np.array([len(x) for x in lists], np.int64)
        begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        values = np.concatenate([*lists, np.empty(0, np.int32)])
        return [pa.ListArray.from_arrays(pa.array(begins), pa.array(values)), pa.array(counts), pa.array(after, pa.string())]

    return _apply(df, keep, text, "ids array<int>, n_tokens long, decoded_sha256 string", rows)

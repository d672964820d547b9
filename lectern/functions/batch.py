"""Tokenizers that work on whole Arrow batches, for use where a Column tokenizer is.

A library tokenizer is loaded once per Python worker and sees a batch of texts at a time. What
it returns is ``array<struct<token,s,e>>`` with character offsets; the form without offsets takes
the tokens from it. Both carry a name, which goes into the paths of stored indexes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import update_wrapper

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.offsets import SPANS
from lectern.functions.text import SpanTokenizer, Tokenizer

# One text's tokens: start and end characters of each.
Offsets = Sequence[tuple[int, int]]
# What a worker loads: texts to the offsets of their tokens.
BatchTokenizer = Callable[[list[str]], list[Offsets]]
# A batch has thousands of texts of any length; Python objects for all their tokens at once would be many times their size.
CHARACTERS_AT_ONCE = 1_000_000
_loaded: dict[str, BatchTokenizer] = {}


def batch_spans(load: Callable[[], BatchTokenizer], name: str) -> SpanTokenizer:
    """A tokenizer with offsets; a null text has null tokens.

    ``load`` runs once per worker and name, so different tokenizers need different names.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _loaded:
            _loaded[name] = load()
        for texts in batches:
            yield _spans(texts, _loaded[name])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, SPANS)
    return _called(lambda text: udf(text), name)


def batch_tokens(load: Callable[[], BatchTokenizer], name: str) -> Tokenizer:
    """The same tokens without offsets."""
    spans = batch_spans(load, name)
    return _called(lambda text: F.transform(spans(text), lambda x: x["token"]), name)


def _called(fn: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
    named = update_wrapper(lambda text: fn(text), fn)
    named.__name__ = named.__qualname__ = name
    return named


def _spans(texts: pa.Array, tokenize: BatchTokenizer) -> pa.Array:
    """Offsets of a batch as an Arrow list of structs, made for about ``CHARACTERS_AT_ONCE`` characters at a time."""
    sizes = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    found, at = [], 0
    while at < len(texts) or not found:
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + CHARACTERS_AT_ONCE, "right")))
        found.append(_slice_spans(texts.slice(at, stop - at), tokenize))
        at = stop
    return found[0] if len(found) == 1 else pa.concat_arrays(found)


def _slice_spans(texts: pa.Array, tokenize: BatchTokenizer) -> pa.Array:
    """Tokens are cut from the texts by character."""
    values = texts.to_pylist()
    found = tokenize([v or "" for v in values])
    counts = np.array([0 if v is None else len(f) for v, f in zip(values, found, strict=True)], np.int64)
    pairs = [(v, s, e) for v, f in zip(values, found, strict=True) if v is not None for s, e in f]
    entries = pa.StructArray.from_arrays(
        [pa.array([v[s:e] for v, s, e in pairs], pa.string()), pa.array([s for _, s, _ in pairs], pa.int32()), pa.array([e for *_, e in pairs], pa.int32())],
        names=["token", "s", "e"],
    )
    begins = np.concatenate([[0], np.cumsum(counts)])
    mask = pa.array([v is None for v in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), entries, mask=mask)

"""Text clean-up and tokenising as Column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import offsets
from lectern.functions.arrays import let

Tokenizer = Callable[[Column], Column]
# A text to ``array<struct<token:string,s:int,e:int>>``: tokens with half-open character offsets. Its attribute ``tokens``,
# if it has one, is a Tokenizer that gives the same tokens and needs no Python worker.
SpanTokenizer = Callable[[Column], Column]

# The characters Unicode counts as white space, as a Java regex class body.
WHITESPACE = (
    "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
# Quotation marks that are cleaned from answers.
ANSWER_QUOTES = "'\"《》<>〈〉‘’「」"
# ASCII punctuation.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_BREAKS = "(?: |\\n|\\\\n)+"


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def is_blank(text: Column) -> Column:
    """True for empty or whitespace-only text."""
    return ~text.rlike(f"[^{WHITESPACE}]")


def normalize_ws(text: Column) -> Column:
    """Runs of space, newline or the two characters backslash-n become one space."""
    return F.regexp_replace(text, _BREAKS, " ")


def compact_key(text: Column) -> Column:
    """The same characters removed, for comparing passages."""
    return F.regexp_replace(text, _BREAKS, "")


def normalize_answer(text: Column) -> Column:
    """Quotation marks become spaces, then white space is collapsed."""
    return collapse_whitespace(F.translate(text, ANSWER_QUOTES, " " * len(ANSWER_QUOTES)))


def squad_normalize(text: Column) -> Column:
    """Lower-case, drop ASCII punctuation and English articles, collapse white space."""
    plain = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    word = "\\p{L}\\p{N}_"
    return collapse_whitespace(F.regexp_replace(plain, f"(?<![{word}])(?:a|an|the)(?![{word}])", " "))


def squad_tokens(text: Column) -> Column:
    """Words of the normalised text; no words for empty text."""
    return F.filter(F.split(squad_normalize(text), " "), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Split at single spaces; empty tokens are kept."""
    return F.split(text, " ")


def tokenize(text: Column, fn: Tokenizer = space_tokens) -> Column:
    """Apply a tokenizer: any Column function, a pandas UDF included."""
    return fn(text)


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, joined by a space."""

    def grams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, many).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*[grams(t, n) for n in range(low, high + 1)]))


def space_spans(text: Column) -> Column:
    """Space tokens with their offsets."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from offsets.space_span_parts(texts)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, offsets.SPANS)(text)


space_spans.tokens = space_tokens


def pattern_spans(pattern: str) -> SpanTokenizer:
    """A tokenizer that takes all matches of a pattern that never matches the empty text.

    What lies between the matches gives their offsets, so nothing is assumed about it.
    """

    def run(tokens: pa.Array, gaps: pa.Array) -> pa.Array:
        return offsets.spans_after_gaps(tokens, gaps)

    run.__annotations__ = {"tokens": pa.Array, "gaps": pa.Array, "return": pa.Array}

    def tokenizer(text: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), F.length)
        return F.arrow_udf(run, offsets.SPANS)(tokenizer.tokens(text), between)

    tokenizer.tokens = lambda text: F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return tokenizer


#: Runs of letters and digits, and every other character that is no white space on its own.
word_spans = pattern_spans(f"[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}{WHITESPACE}]")


def token_ids(tokens: Column, vocab_size: int = 32000, reserved: int = 5) -> Column:
    """Hashed token ids in ``[reserved, vocab_size)``; lower ids stay free for special tokens."""
    return F.transform(tokens, lambda t: (hash32(t) % (vocab_size - reserved) + reserved).cast("int"))


def hash32(text: Column) -> Column:
    """First 32 bits of the MD5 digest as a non-negative BIGINT: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pad_truncate(values: Column, max_len: int, pad: Column) -> Column:
    """``struct<input_ids, attention_mask>`` of exactly ``max_len`` entries."""

    def padded(v: Column) -> Column:
        kept = F.least(F.size(v), F.lit(max_len))
        fill = F.lit(max_len) - kept
        return F.struct(
            F.concat(F.slice(v, 1, max_len), F.array_repeat(pad, fill)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
        )

    return let(values, padded)

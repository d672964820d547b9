"""Quality rules: a threshold table compiled into one projection.

No user functions, no shuffle: every measure is an expression over the row's text and the
whole table of rules becomes one boolean column.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; very
long texts cost ``n log n`` in their words; equal rows get equal verdicts; columns of the
input with a name that the operator writes are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import let

SPACES = " \t\n\x0b\x0c\r"
BREAKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from an or "
    "der die und in den von zu das mit sich des auf für ist im dem nicht eine ein als auch es "
    "de la le et les des en un du une que pour est dans qui par au sur pas avec il ne "
    "el los se las del por con no su para al lo y una como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``."""

    name: str
    measure: str
    low: float
    high: float


#: The default table; measures are those of ``MEASURES``.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("words", "n_words", 50, 10_000_000),
    Rule("symbols", "symbol_ratio", 0.0, 0.1),
    Rule("stop_words", "stop_ratio", 0.06, 0.8),
    Rule("repeated_lines", "dup_line_ratio", 0.0, 0.5),
    Rule("bullets", "bullet_line_ratio", 0.0, 0.9),
    Rule("cut_lines", "ellipsis_line_ratio", 0.0, 0.3),
)

#: Ratios by name, over the counts of ``measured`` (a struct).
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda c: c["n_words"],
    "mean_word_chars": lambda c: _ratio(c["word_chars"], c["n_words"]),
    "symbol_ratio": lambda c: _ratio(c["n_symbols"], c["n_words"]),
    "stop_ratio": lambda c: _ratio(c["n_stop_words"], c["n_words"]),
    "dup_line_ratio": lambda c: _ratio(c["n_dup_lines"], c["n_lines"]),
    "bullet_line_ratio": lambda c: _ratio(c["n_bullet_lines"], c["n_lines"]),
    "ellipsis_line_ratio": lambda c: _ratio(c["n_ellipsis_lines"], c["n_lines"]),
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_stop_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def words_in(text: Column) -> Column:
    """Words of a text; none for null or white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BREAKS)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, the first one included.

    Windows are sorted with their positions; equal neighbours are repeats. Sorted positions
    then cover three words each, less their overlap.
    """

    def windows(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        triples = F.zip_with(pairs, F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        placed = F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        return F.sort_array(F.filter(placed, lambda x: x["t"].isNotNull()))

    def places(s: Column) -> Column:
        equal = F.zip_with(
            s,
            F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
            lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(windows(words), lambda s: let(places(s), covered))


def _line_counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(
        F.coalesce(lines, F.array().cast("array<string>")),
        lambda rows: F.struct(
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(rows, lambda x: x.rlike("^[\\x20\\x09]*[-*•‣·]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(rows, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        ),
    )


def _word_counts(text: Column, stop_words: tuple[str, ...] | list[str]) -> Column:
    return let(
        words_in(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def measured(text: Column, stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> Column:
    """The counts that the rules use, as one struct."""
    whole = F.coalesce(text, F.lit(""))
    chars = {
        "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
    }
    parts = F.struct(_word_counts(text, stop_words).alias("w"), _line_counts(text).alias("l"), *(c.alias(n) for n, c in chars.items()))

    def merged(p: Column) -> Column:
        own = {f: p["w"][f] for f in ("n_words", "n_stop_words", "n_repeat_words")}
        own |= {f: p["l"][f] for f in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
        own |= {f: p[f] for f in chars}
        return F.struct(*(own[f].alias(f) for f in COUNTS))

    return let(parts, merged)


def verdict(
    text: Column,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS),
) -> Column:
    """Counts, ``base_failed``, ``failed`` and ``kept`` of a text as one struct.

    The counts are bound once inside the expression, so a filter on a part of it that the
    optimizer moves below a projection does not count again for each rule.
    """

    def judged(c: Column) -> Column:
        base = (c["n_words"] < min_words) | (F.lit(100) * c["n_repeat_words"] > F.lit(max_repeat_percent) * c["n_words"])
        broken = [F.when(~MEASURES[r.measure](c).between(r.low, r.high), F.lit(r.name)) for r in rules]
        failed = F.filter(F.array(*broken), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
        return let(
            F.struct(base.alias("base"), failed.alias("failed")),
            lambda v: F.struct(
                *(c[f].alias(f) for f in COUNTS),
                v["base"].alias("base_failed"),
                v["failed"].alias("failed"),
                (~v["base"] & (F.size(v["failed"]) == 0)).alias("kept"),
            ),
        )

    return let(measured(text, stop_words), judged)


def quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS),
) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    made = (*COUNTS, "base_failed", "failed", "kept")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made and c != "_q"]
    judged = docs.withColumn("_q", verdict(F.col(f"`{text}`"), rules, min_words, max_repeat_percent, stop_words))
    return judged.select(*kept, *(F.col(f"_q.{f}").alias(f) for f in made))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return docs.where(verdict(F.col(f"`{text}`"), rules)["kept"])

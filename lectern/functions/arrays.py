"""In-row array helpers.

They work on one row's array, so none of them needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
LEVELS = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside a lambda is re-evaluated for every element; binding it
    as a lambda variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def rows_of(df: DataFrame, keep: list[str], values: Column, name: str = "item") -> DataFrame:
    """``keep`` columns and one row per element of an array of non-null elements.

    A plain ``explode`` makes the optimizer filter on the size of the array first, which
    computes a long array expression a second and third time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def running_ends(lengths: Column) -> Column:
    """Running sum of an INT array, as an array of the same size.

    Sums are built per chunk and shifted by the totals of the chunks before, which are
    running sums again: with two levels of chunks the cost stays linear for very long arrays.
    """
    sums = let(lengths, lambda v: _ends(v, LEVELS))
    return F.when(F.size(lengths) > 0, sums).otherwise(_no_ints())


def _ends(values: Column, levels: int) -> Column:
    if levels == 0:
        return F.aggregate(values, _no_ints(), _append_sum)
    last_chunk = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), last_chunk),
        lambda c: F.aggregate(F.slice(values, c * CHUNK + 1, CHUNK), _no_ints(), _append_sum),
    )

    def shifted(own: Column) -> Column:
        totals = F.transform(own, lambda chunk: F.element_at(chunk, -1))
        return let(
            let(totals, lambda t: _ends(t, levels - 1)),
            lambda ends: F.flatten(F.transform(own, lambda chunk, c: F.transform(chunk, lambda x: x + F.coalesce(F.get(ends, c - 1), F.lit(0))))),
        )

    return let(chunks, shifted)


def _no_ints() -> Column:
    return F.array().cast("array<int>")


def _append_sum(acc: Column, x: Column) -> Column:
    return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))


def value_counts(values: Column) -> Column:
    """Distinct values of an array with their counts, ``array<struct<term,tf>>``.

    Sorts the array and reads the run lengths.
    """

    def counted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            starts,
            lambda p: F.transform(
                p,
                lambda i, j: F.struct(
                    F.element_at(s, i).alias("term"),
                    (F.coalesce(F.get(p, j + 1), n + 1) - i).cast("long").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(values) > 0, let(F.sort_array(values), counted)).otherwise(empty)


def occurrence_labels(values: Column) -> Column:
    """Each value with the number of its occurrence, so a multiset becomes a set."""
    return F.flatten(
        F.transform(
            value_counts(values),
            lambda c: F.transform(F.sequence(F.lit(1).cast("long"), c["tf"]), lambda i: F.concat_ws("\u0001", c["term"], i)),
        )
    )


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over values of the smaller of the two counts."""
    return F.size(F.array_intersect(occurrence_labels(a), occurrence_labels(b)))

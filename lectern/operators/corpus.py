"""De-duplication, concatenation, splits and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import hash32, is_blank
from lectern.operators.ranking import with_position


def dedup_corpus(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct text; the smallest id stands for the first occurrence.

    Grouping by the text itself is exact, and partial aggregation keeps one row per
    copy group and task before the shuffle, so a heavily copied text is no hot key.
    """
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(doc_id).alias(doc_id)).select(doc_id, text)


def concat(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Append data sets; missing columns become null, copies are kept."""
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def hash_split(df: DataFrame, key: str = "id", fraction: float = 0.1, out: str = "split") -> DataFrame:
    """Label rows ``train`` / ``validation`` by a hash of the key: repeatable, no shuffle."""
    bucket = hash32(F.col(key).cast("string")) % 10000
    return df.withColumn(out, F.when(bucket < round(fraction * 10000), "validation").otherwise("train"))


def train_test_split(df: DataFrame, key: str = "id", fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    labelled = hash_split(df, key, fraction, "_split")
    return (
        labelled.where(F.col("_split") == "train").drop("_split"),
        labelled.where(F.col("_split") == "validation").drop("_split"),
    )


def percent_slice(df: DataFrame, key: str = "doc_id", percent: int = 5, out: str = "split") -> DataFrame:
    """First ``percent`` of the rows in key order are ``validation``, the rest ``train``.

    Only the key column is ordered, to find the last key of the slice; the rows
    themselves are compared with it and never move.
    """
    keys = df.select(key)
    total = keys.agg(F.count("*")).scalar()
    size = F.round(total * F.lit(percent / 100)).cast("long")
    last = with_position(keys, key).where(F.col("position") < size).agg(F.max(key)).scalar()
    inside = F.coalesce(F.col(key) <= last, F.lit(False))
    return df.withColumn(out, F.when(inside, "validation").otherwise("train"))


def take_first(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Cap a data set at its first ``n`` rows in key order."""
    return df.orderBy(key).limit(n)


def drop_blank_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def resolve_columns(df: DataFrame, roles: Sequence[str] | Mapping[str, int]) -> dict[str, str]:
    """Map each role to the column of that name, else to the column at its position."""
    places = roles if isinstance(roles, Mapping) else {role: i for i, role in enumerate(roles)}
    return {role: role if role in df.columns else df.columns[i] for role, i in places.items()}


def select_roles(df: DataFrame, roles: Sequence[str] | Mapping[str, int]) -> DataFrame:
    """Project to the role columns under their role names."""
    return df.select(*[F.col(f"`{col}`").alias(role) for role, col in resolve_columns(df, roles).items()])


def with_normalized(df: DataFrame, fn, text: str = "text", out: str | None = None) -> DataFrame:
    """Apply a text clean-up function to a column."""
    cleaned: Column = fn(F.col(text))
    return df.withColumn(out or text, cleaned)

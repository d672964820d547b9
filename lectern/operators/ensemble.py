"""Comparing and combining prediction sets ``(id, text)`` and n-best lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the override rules.
LOW_PAIR_CONFIDENCE = 0.35
CHALLENGER_LEAD = 0.35
OUTVOTED_LEAD = 0.3
OTHER_LEAD = 0.4


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, a, b)`` of two prediction sets; an id may be missing on either side."""
    left = a.select("id", F.col("text").alias("a"))
    return left.join(b.select("id", F.col("text").alias("b")), "id", "full")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of ids with equal answers."""
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return paired(a, b).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids whose answers differ."""
    return paired(a, b).where(~F.col("a").eqNullSafe(F.col("b"))).select("id")


def differs_from_all(base: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Ids where every other set differs from the base."""
    return reduce(lambda x, y: x.intersect(y), [differences(base, o) for o in others])


def differs_from_any(base: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Ids where at least one other set differs from the base."""
    return reduce(lambda x, y: x.union(y), [differences(base, o) for o in others]).distinct()


def side_by_side(sets: Mapping[str, DataFrame], differing: tuple[str, str]) -> DataFrame:
    """Answers of all sets, one column each, where two of them differ."""
    tables = [df.select("id", F.col("text").alias(name)) for name, df in sets.items()]
    first, second = differing
    joined = reduce(lambda x, y: x.join(y, "id"), tables)
    return joined.where(~F.col(first).eqNullSafe(F.col(second)))


def max_probability(nbest: DataFrame) -> DataFrame:
    """``(id, probability)``: the highest probability of each question."""
    return nbest.groupBy("id").agg(F.max("probability").alias("probability"))


def confidence_summary(confidence: DataFrame, thresholds: Sequence[float] = (0.5, 0.7, 0.8)) -> DataFrame:
    """Mean, smallest and largest confidence, and how many lie below each threshold."""
    p = F.col("probability")
    below = [F.count_if(p < t).alias(f"below_{int(round(t * 100))}") for t in thresholds]
    return confidence.agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), *below
    )


def pair_confidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean confidence of two models per question."""
    joined = a.select("id", F.col("probability").alias("a")).join(b.select("id", F.col("probability").alias("b")), "id")
    return joined.select("id", ((F.col("a") + F.col("b")) / 2).alias("probability"))


def model_table(nbest: DataFrame, name: str) -> DataFrame:
    """``(id, <name>_text, <name>_p)`` from an n-best list: its first answer and best probability."""
    return nbest.groupBy("id").agg(
        F.min_by("text", "rank").alias(f"{name}_text"), F.max("probability").alias(f"{name}_p")
    )


def combined(models: Mapping[str, DataFrame]) -> DataFrame:
    """Model tables joined on ``id``."""
    return reduce(lambda x, y: x.join(y, "id"), [model_table(nbest, name) for name, nbest in models.items()])


def _pair_mean(base: str, partner: str) -> Column:
    return (F.col(f"{base}_p") + F.col(f"{partner}_p")) / 2


def _leads(base: str, other: str, lead: float) -> Column:
    return (F.col(f"{base}_p") + lead <= F.col(f"{other}_p")) & (F.col(f"{base}_text") != F.col(f"{other}_text"))


def ensemble_rules(table: DataFrame, base: str, partner: str, challenger: str) -> DataFrame:
    """Add the three override flags.

    ``rule1``: base and partner are unsure. ``rule2``: the challenger leads the base and
    differs. ``rule3``: base and partner agree, the challenger differs and leads their mean.
    """
    mean = _pair_mean(base, partner)
    text = lambda name: F.col(f"{name}_text")
    outvoted = (
        (mean + OUTVOTED_LEAD <= F.col(f"{challenger}_p"))
        & (text(base) == text(partner))
        & (text(base) != text(challenger))
    )
    return (
        table.withColumn("rule1", mean < LOW_PAIR_CONFIDENCE)
        .withColumn("rule2", _leads(base, challenger, CHALLENGER_LEAD))
        .withColumn("rule3", outvoted)
    )


def ensemble_flags(table: DataFrame, base: str, fourth: str, fifth: str) -> DataFrame:
    """Flag questions where a further model leads the base clearly and differs."""
    return table.withColumn("rule4", _leads(base, fourth, OTHER_LEAD)).withColumn("rule5", _leads(base, fifth, OTHER_LEAD))


def ensemble_apply(table: DataFrame, base: str, challenger: str) -> DataFrame:
    """Final answers: the challenger's where any of the three rules fires, else the base's."""
    fired = F.col("rule1") | F.col("rule2") | F.col("rule3")
    return table.select("id", F.when(fired, F.col(f"{challenger}_text")).otherwise(F.col(f"{base}_text")).alias("text"))

"""Corpus profiling: counts, lengths, histogram, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import Tokenizer, space_tokens


def corpus_counts(df: DataFrame, text: str = "text", approximate: bool = False) -> DataFrame:
    """Raw and distinct document counts."""
    distinct = F.approx_count_distinct(text) if approximate else F.countDistinct(text)
    return df.agg(F.count(text).alias("n_raw"), distinct.alias("n_distinct"))


def char_length(text: str = "text") -> Column:
    return F.length(text).cast("long")


def token_length(text: str = "text", tokenizer: Tokenizer = space_tokens) -> Column:
    return F.size(tokenizer(F.col(text))).cast("long")


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """Longest, shortest and mean length."""
    return df.select(length.alias("len")).agg(
        F.count("len").alias("n"),
        F.max("len").alias("longest"),
        F.min("len").alias("shortest"),
        F.avg("len").alias("mean_length"),
    )


def length_histogram(df: DataFrame, length: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins from the shortest to the longest; the last bin is closed.

    Rows are first counted per distinct length, so binning works on that small table.
    """
    counts = df.select(length.alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    with_bounds = counts.withColumn("b", bounds.select(F.struct("lo", "hi")).scalar()).select("len", "n", "b.*")
    bin_no = F.when(flat, F.lit(bins // 2)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("len") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))
    )
    filled = with_bounds.select(bin_no.cast("long").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def length_threshold(df: DataFrame, length: Column, at_least: int) -> DataFrame:
    """Number of documents at or above a length."""
    return df.agg(F.count_if(length >= at_least).alias("n_long"))

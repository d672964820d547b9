"""Top-k per group and global row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialized

SCORE_DIGITS = 6


def top_k(
    df: DataFrame,
    by: str | Sequence[str],
    k: int,
    score: str = "score",
    item: str = "doc_id",
    largest: bool = True,
    rank: str = "rank",
) -> DataFrame:
    """Best ``k`` rows per group with a 1-based BIGINT rank.

    Scores are compared after rounding, ties go to the smaller item. The filter sits
    directly on ``row_number`` so every task keeps only ``k`` rows per group before
    the shuffle: a group with most of the rows costs no more than a small one.
    """
    by = [by] if isinstance(by, str) else list(by)
    key = F.round(F.col(score), SCORE_DIGITS)
    order = Window.partitionBy(*by).orderBy(key.desc() if largest else key.asc(), F.col(item).asc())
    ranked = df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def with_position(df: DataFrame, key: str, buckets: int | None = None, out: str = "position") -> DataFrame:
    """0-based position of every row in the order of a unique ``key`` of any orderable type.

    Only the keys are sorted and numbered: each range on its own, shifted by the sizes of the
    ranges before. They are written once and joined back if there are other columns.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(key).repartitionByRange(buckets, key).sortWithinPartitions(key)
    rows = materialized(ordered.withColumn("_at", F.monotonically_increasing_id()), "positions")
    rows = rows.select(key, F.shiftright("_at", 33).cast("int").alias("_bucket"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"))
    placed = rows.join(F.broadcast(_offsets(rows)), "_bucket").select(key, (F.col("_offset") + F.col("_row")).alias(out))
    return placed if df.columns == [key] else df.join(placed, key)


def with_hashed_position(df: DataFrame, hash_col: Column, key: str, buckets: int | None = None, out: str = "position") -> DataFrame:
    """Position in the order of a uniform 32-bit hash (ties by ``key``): a repeatable shuffle."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_hash", hash_col)
    bucket = F.shiftright(F.col("_hash") * buckets, 32).cast("int")
    return _number(hashed.withColumn("_bucket", bucket), ["_hash", key], out).drop("_hash")


def _offsets(df: DataFrame) -> DataFrame:
    """Rows before each bucket."""
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # One row per bucket, so this unpartitioned window stays tiny.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))


def _number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = df.withColumn("_row", within).join(F.broadcast(_offsets(df)), "_bucket")
    return numbered.withColumn(out, F.col("_offset") + F.col("_row") - 1).drop("_bucket", "_offset", "_row")

"""Clustered vector search: k-means cells, scalar quantisation, search in the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.vectors import as_double, l2_normalize
from lectern.operators.dense import arrow_matrix, cell_topk, dense_topk, similarity
from lectern.operators.ranking import SCORE_DIGITS
from lectern.session import materialized

# Numbers of the centroid table that every task holds at a time.
VALUES_AT_ONCE = 8_000_000


def ivf_fit(vectors: DataFrame, num_clusters: int = 64, metric: str = "inner_product", seed: int = 42, vec: str = "embedding") -> DataFrame:
    """K-means centroids ``(cluster_id, centroid)``; vectors are normalised first for inner product."""
    values = l2_normalize(F.col(vec)) if metric == "inner_product" else as_double(F.col(vec))
    features = vectors.where(F.col(vec).isNotNull()).select(array_to_vector(values).alias("features"))
    centers = KMeans(k=num_clusters, seed=seed, featuresCol="features").fit(features).clusterCenters()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return vectors.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")


def ivf_assign(vectors: DataFrame, centroids: DataFrame, metric: str = "inner_product", vec: str = "embedding", values_at_once: int = VALUES_AT_ONCE) -> DataFrame:
    """Add the nearest ``cluster_id`` to every non-null vector; ties go to the smaller id. No shuffle.

    Tasks hold at most ``values_at_once`` numbers of the centroid table. A larger table is dealt
    into parts by hash of the id; each part is one more pass that keeps the better cell.
    """
    table = materialized(centroids.select("cluster_id", as_double(F.col("centroid")).alias("centroid")), "centroids")
    size = table.agg(F.sum(F.size("centroid"))).first()[0] or 0
    parts = max(1, -(-size // values_at_once))
    out = vectors
    for part in range(parts):
        own = table if parts == 1 else table.where(F.pmod(F.xxhash64("cluster_id"), F.lit(parts)) == part)
        out = _nearest(out, own, metric, vec)
        out = materialized(out, "assigned") if parts > 1 else out
    return out.drop("_score")


def _nearest(vectors: DataFrame, centroids: DataFrame, metric: str, vec: str) -> DataFrame:
    """``cluster_id`` and ``_score`` of the best of these centroids and what a row has already."""
    rows = sorted(centroids.collect(), key=lambda r: r[0])
    id_type = centroids.schema["cluster_id"].dataType
    ids = pa.array([r[0] for r in rows], to_arrow_type(id_type))
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in rows], dtype=float))
    again = "_score" in vectors.columns
    fields = [f for f in vectors.schema.fields if f.name not in ("cluster_id", "_score") or not again]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(vec).is_valid())
            if not batch.num_rows or (not len(ids) and not again):
                continue
            own = batch.select([f.name for f in fields])
            if not len(ids):
                yield own.append_column("cluster_id", batch.column("cluster_id")).append_column("_score", batch.column("_score"))
                continue
            scores = np.round(similarity(arrow_matrix(batch.column(vec)), shared.value, metric), SCORE_DIGITS)
            scores = -scores if metric == "l2" else scores
            nearest = scores.argmax(axis=1)
            best, cell = scores[np.arange(len(scores)), nearest], ids.take(pa.array(nearest))
            if again:
                old, had = batch.column("_score").to_numpy(), batch.column("cluster_id")
                smaller = pc.less(had, cell).to_numpy(zero_copy_only=False)
                keep = (old > best) | ((old == best) & smaller)
                cell, best = pc.if_else(pa.array(keep), had, cell), np.where(keep, old, best)
            yield own.append_column("cluster_id", cell).append_column("_score", pa.array(best))

    schema = T.StructType([*fields, T.StructField("cluster_id", id_type), T.StructField("_score", T.DoubleType())])
    return vectors.mapInArrow(assign, schema)


def ivf_build(
    vectors: DataFrame,
    num_clusters: int = 64,
    metric: str = "inner_product",
    seed: int = 42,
    vec: str = "embedding",
    centroids: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit centroids unless given, and assign: ``(centroids, vectors with cluster_id)``; the latter are written once."""
    if metric == "inner_product":
        vectors = vectors.withColumn(vec, l2_normalize(F.col(vec)))
    centroids = ivf_fit(vectors, num_clusters, metric, seed, vec) if centroids is None else centroids
    return centroids, materialized(ivf_assign(vectors, centroids, metric, vec), "ivf-cells")


def ivf_topk(
    questions: DataFrame, centroids: DataFrame, cells: DataFrame, k: int = 10, nprobe: int = 1, metric: str = "inner_product", vec: str = "embedding"
) -> DataFrame:
    """Top ``k`` within the ``nprobe`` nearest cells; ``l2`` scores are squared distances."""
    as_passages = centroids.select(F.col("cluster_id").alias("doc_id"), F.col("centroid").alias(vec))
    q = questions.select("qid", F.col(vec).alias("v"))
    probes = materialized(
        probe_cells(questions, as_passages, nprobe, metric, vec)
        .join(q, "qid")
        .select("qid", "v", F.col("doc_id").alias("cell")),
        "probes",
    )
    p = cells.select("doc_id", F.col(vec).alias("v"), F.col("cluster_id").alias("cell"))
    return cell_topk(probes, p, k, metric)


def probe_cells(questions: DataFrame, centroids: DataFrame, nprobe: int, metric: str, vec: str) -> DataFrame:
    return dense_topk(questions, centroids, nprobe, metric, vec).select("qid", "doc_id")


def ivf_search(
    spark: SparkSession, vector: list[float], centroids: DataFrame, cells: DataFrame, k: int = 10, nprobe: int = 1, metric: str = "inner_product"
) -> DataFrame:
    """One question given as a vector."""
    one = spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, embedding array<double>")
    return ivf_topk(one, centroids, cells, k, nprobe, metric)


def quantizer_bounds(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Smallest and largest value per dimension, ``(lo, hi)`` arrays in one row."""
    packed = vectors.select(array_to_vector(as_double(F.col(vec))).alias("v"))
    return packed.agg(Summarizer.min(F.col("v")).alias("lo"), Summarizer.max(F.col("v")).alias("hi")).select(
        vector_to_array("lo").alias("lo"), vector_to_array("hi").alias("hi")
    )


def scalar_quantize(vectors: DataFrame, bits: int = 8, vec: str = "embedding", out: str = "codes", bounds: DataFrame | None = None) -> DataFrame:
    """Replace every value by its step between the dimension's bounds, an array of numbers (``quantized`` packs bytes).

    Bounds of other vectors may be given; values outside them take the nearest step.
    """
    levels = (1 << bits) - 1
    own = quantizer_bounds(vectors, vec) if bounds is None else bounds
    bounded = vectors.withColumn("_b", own.select(F.struct("lo", "hi")).scalar())

    def step(x: Column, b: Column) -> Column:
        width = b["hi"] - b["lo"]
        at = F.floor((x - b["lo"]) / width * levels + 0.5)
        return F.when(width > 0, F.greatest(F.least(at, F.lit(levels)), F.lit(0))).otherwise(0).cast("int")

    pairs = F.arrays_zip(F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))
    return bounded.withColumn(out, F.zip_with(as_double(F.col(vec)), pairs, step)).drop("_b")


def scalar_decode(coded: DataFrame, bounds: DataFrame, bits: int = 8, codes: str = "codes", out: str = "decoded") -> DataFrame:
    """Approximate vectors from codes and bounds."""
    levels = (1 << bits) - 1
    bounded = coded.withColumn("_b", bounds.select(F.struct("lo", "hi")).scalar())
    pairs = F.arrays_zip(F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))
    decoded = F.zip_with(codes, pairs, lambda c, b: b["lo"] + c / levels * (b["hi"] - b["lo"]))
    return bounded.withColumn(out, decoded).drop("_b")

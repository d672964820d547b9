"""Exact Lloyd clustering of integer vectors with bounds that are loosened geometrically.

A vector keeps an upper bound on the distance to its own centroid and a lower bound on the
distance to any other. When centroids have moved, the upper bound grows by its centroid's
drift. The lower bound falls by what the moved centroids can have come nearer to *any* point
of the cluster's sphere, not by their full drift: with ``m`` the middle between a centroid's
old and new place at distance ``drift``, a point at angle ``a`` to the direction of the move,
seen from ``m``, comes nearer by at most ``drift * cos(a)`` (the two distances add up to no less
than twice the distance from ``m``). A sphere of radius ``r`` around a point at distance ``d``
and angle ``a0`` reaches down to the angle ``a0 - asin(r / d)``; the sphere, the two places and the
angle lie in one plane. A vector whose upper bound stays below its lower bound, or below half
the distance from its centroid to the next one, keeps its cluster unread; all others are
compared with every centroid in whole numbers, so results are exact.

A round is one pass in Arrow batches over the table of vectors and bounds, which writes them
anew, together with one row of sums for each task and cluster that changed. Only these sums,
added up by Spark, reach the driver: clusters x components numbers. Vectors are not shuffled.

Defined cases: vectors that are null, of another length, or hold a null or a number that is
not finite are left out; components beyond 2**27 are clipped to it, which keeps every squared
distance in a BIGINT; rows with equal or null ids are vectors of their own (a null id is the
last choice as a start); ties go to the smaller cluster; with fewer vectors than clusters
there are as many clusters as vectors; an empty table has no rows. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialized, scratch_mark

SCALE = 1024
LIMIT = 1 << 27
ROWS_AT_ONCE = 8192
#: Relative and absolute room for rounding in comparisons of bounds.
EPS, TINY = 1e-9, 1e-6
_SUMS = "cluster int, n long, total array<long>, distance decimal(38,0), radius double"


def whole_vectors(df: DataFrame, dim: int = 64, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Complete vectors of ``dim`` finite numbers as ``x array<int>``: ``floor(scale * component)``."""
    values = F.col(f"`{vec}`").cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = df.where((F.size(values) == dim) & finite)
    clipped = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return own.withColumn("x", F.transform(values, lambda v: clipped(F.greatest(F.least(v, F.lit(1e9)), F.lit(-1e9)))))


def first_centroids(vectors: DataFrame, k: int, seed: int, id_col: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


@dataclass(frozen=True)
class Move:
    """Centroids of a round and what their last move does to the bounds."""

    centroids: np.ndarray
    drift: np.ndarray
    fall: np.ndarray
    apart: np.ndarray


def planar_fall(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most by which another centroid's move brings it nearer to a point of the cluster's sphere.

    Spheres lie around the old centroids; ``radius`` is below 0 for a cluster without vectors.
    """
    k = len(old)
    step = (new - old).astype(float)
    drift = np.sqrt((step**2).sum(1))
    fall = np.zeros((k, k))
    for i in range(k):
        if radius[i] < 0:
            continue
        seen = old[i] - (old + new) / 2.0
        far = np.sqrt((seen**2).sum(1))
        along = (seen * step).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(along / (far * drift), -1, 1))
            spread = np.arcsin(np.clip(radius[i] * (1 + EPS) / far, 0, 1))
        least = np.maximum(angle - spread, 0)
        bound = drift * np.maximum(np.cos(least), 0)
        fall[i] = np.where((far <= radius[i] * (1 + EPS)) | (drift == 0), drift, np.minimum(bound, drift))
        fall[i, i] = 0
    return fall.max(1) * (1 + EPS) + TINY


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1))
    gaps = np.sqrt(((new[:, None] - new[None]).astype(float) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    return Move(new, drift * (1 + EPS) + TINY, planar_fall(old, new, radius), gaps.min(1) / 2)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the row of ``c``, or to the one ``c``, in whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> int:
    """Bring clusters and bounds of a batch up to date in place; the number of vectors that were scanned."""
    known = np.flatnonzero(cluster >= 0)
    own = cluster[known]
    upper[known] += move.drift[own]
    lower[known] -= move.fall[own]
    safe = np.full(len(x), -np.inf)
    safe[known] = np.maximum(lower[known], move.apart[own])
    todo = np.flatnonzero(~(upper * (1 + EPS) + TINY < safe))
    again = todo[cluster[todo] >= 0]
    upper[again] = np.sqrt(squares(x[again], move.centroids[cluster[again]]).astype(float))
    todo = todo[~(upper[todo] * (1 + EPS) + TINY < safe[todo])]
    if len(todo):
        all_of = np.stack([squares(x[todo], c) for c in move.centroids], 1)
        best = all_of.argmin(1)
        cluster[todo] = best
        upper[todo] = np.sqrt(all_of[np.arange(len(todo)), best].astype(float))
        all_of[np.arange(len(todo)), best] = np.iinfo(np.int64).max
        lower[todo] = np.sqrt(all_of.min(1).astype(float)) if all_of.shape[1] > 1 else np.inf
    return len(todo)


def _step(table: DataFrame, move: Move, last: bool) -> DataFrame:
    """Rows of ``part`` 0 (vectors with clusters and bounds) and of ``part`` 1 (sums of a task)."""
    names = table.columns
    shared = table.sparkSession.sparkContext.broadcast(move)
    k, dim = move.centroids.shape
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    schema = f"{kinds}, part int, squared long, {_SUMS.replace('cluster', 'of')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        distance, radius = [0] * k, np.full(k, -1.0)
        first = None
        for big in batches:
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                batch = big.slice(at, ROWS_AT_ONCE)
                first = batch.slice(0, 0) if first is None else first
                x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, dim)
                cluster, upper, lower = (batch.column(c).to_numpy().copy() for c in ("cluster", "upper", "lower"))
                before = cluster.copy()
                reassign(x, cluster, upper, lower, own)
                changed = np.flatnonzero(before != cluster)
                for c, sign in ((before, -1), (cluster, 1)):
                    some = changed[c[changed] >= 0]
                    np.add.at(total, c[some], sign * x[some])
                    n += sign * np.bincount(c[some], minlength=k)
                np.maximum.at(radius, cluster, upper)
                squared = squares(x, own.centroids[cluster]) if last else np.zeros(len(x), np.int64)
                if last:
                    for c in range(k):
                        distance[c] += sum(squared[cluster == c].tolist())
                made = {"cluster": pa.array(cluster, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower)}
                columns = [made.get(c, batch.column(c)) for c in names]
                yield _rows(columns, names, 0, squared, None, batch.num_rows)
        if first is not None:
            some = np.flatnonzero((n != 0) | (total != 0).any(1) | (radius >= 0))
            empty = [pa.nulls(len(some), c.type) for c in first.columns]
            sums = [
                pa.array(some, pa.int32()), pa.array(n[some]), pa.array([t.tolist() for t in total[some]], pa.list_(pa.int64())),
                pa.array([distance[c] for c in some], pa.decimal128(38, 0)), pa.array(radius[some]),
            ]
            yield _rows(empty, names, 1, np.zeros(len(some), np.int64), sums, len(some))

    return table.mapInArrow(run, schema)


def _rows(columns: list[pa.Array], names: list[str], part: int, squared: np.ndarray, sums: list[pa.Array] | None, n: int) -> pa.RecordBatch:
    if sums is None:
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0), pa.float64())
        sums = [pa.nulls(n, t) for t in kinds]
    marks = [pa.array(np.full(n, part), pa.int32()), pa.array(squared, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *marks, *sums], names=[*names, "part", "squared", "of", "n", "total", "distance", "radius"])


def _pass(table: DataFrame, move: Move, last: bool, since: int) -> tuple[DataFrame, DataFrame]:
    """Write one pass, in place of the one before; the table of vectors and the sums of the tasks."""
    written = materialized(_step(table, move, last), "clusters", since)
    return written.where("part = 0"), written.where("part = 1")


def _collected(sums: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Counts, sums, radii and inertias of all tasks by cluster."""
    each = sums.groupBy("of").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("distance")).alias("distance")
    )
    parts = sums.select("of", F.posexplode("total").alias("at", "v")).groupBy("of", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    n, radius, distance = np.zeros(k, object), np.full(k, -1.0), [0] * k
    total = np.zeros((k, dim), object)
    for r in each.collect():
        n[r.of], radius[r.of], distance[r.of] = int(r.n), r.radius, int(r.distance)
    for r in parts.collect():
        total[r.of, r.at] = int(r.v)
    return n, total, radius, distance


@dataclass(frozen=True)
class Clusters:
    """``vectors`` with ``cluster`` and ``squared`` (distance), the final centroids and the inertia of each cluster."""

    vectors: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def fit(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, id_col: str = "vec_id", vec: str = "embedding") -> Clusters:
    """``rounds`` rounds of assignment and of new centroids (floor of the mean), then a last assignment.

    A cluster without vectors keeps its centroid. ``vectors`` has the columns ``id_col``, ``x``,
    ``cluster`` and ``squared``.
    """
    spark = df.sparkSession
    start = whole_vectors(df, dim, vec).select(F.col(f"`{id_col}`").alias("_id"), "x")
    start = start.select("_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    since = scratch_mark(spark)
    table = materialized(start, "vectors")
    centroids = first_centroids(table, k, seed, "_id")
    k = len(centroids)
    if not k:
        empty = table.select(F.col("_id").alias(id_col), "x", "cluster", F.lit(0).cast("long").alias("squared"))
        return Clusters(empty, centroids.reshape(0, dim), [])
    move = moved(centroids, centroids, np.full(k, -1.0))
    counts, totals = np.zeros(k, object), np.zeros((k, dim), object)
    for _ in range(rounds):
        table, sums = _pass(table.select("_id", "x", "cluster", "upper", "lower"), move, False, since)
        n, total, radius, _inertia = _collected(sums, k, dim)
        counts, totals = counts + n, totals + total
        new = [[int(t) // int(c) for t in row] if c else old for row, c, old in zip(totals, counts, move.centroids.tolist(), strict=True)]
        move = moved(move.centroids, np.array(new, np.int64), radius)
    table, sums = _pass(table.select("_id", "x", "cluster", "upper", "lower"), move, True, since)
    inertia = _collected(sums, k, dim)[3]
    return Clusters(table.select(F.col("_id").alias(id_col), "x", "cluster", "squared"), move.centroids, inertia)


def facts(found: Clusters, id_col: str = "vec_id") -> DataFrame:
    """One row per vector: ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return found.vectors.select(
        F.col(f"`{id_col}`"),
        "cluster",
        F.col("squared").alias("distance"),
        of_cluster(found.inertia, "long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )

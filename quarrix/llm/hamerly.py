"""Centroid clustering in integers, with Hamerly's bounds.

Every vector carries one upper bound of the distance to its own centroid and
one lower bound of the distance to the second nearest.  When centroids move,
the bounds are loosened by how far they moved; a vector whose bounds still
tell its centroid from all others is not compared with any.  The rest get a
full scan in exact integers.  Bounds are kept in floating point with a margin
far above its error, so that they only ever decide what they prove; ties are
never proved, so they always reach the scan.

The state of all vectors is written after each round, so a lost executor costs
its own part of one round.  Between rounds the driver holds the centroids and
their exact sums, ``k`` rows whatever the input; only vectors that changed
their centroid enter the next sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, staged

SCALE = 1024
#: Greatest absolute component: squared distances of 64 such components stay within 64 bits.
LIMIT = 1 << 27
_MARGIN = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower double, full_scans int"


def integer_vectors(vectors: DataFrame, width: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: components times 1024, rounded down; rows of another width or with a null or non-finite component are left out.

    So are rows with a component beyond ``LIMIT``, whose squared distances do
    not fit a long.
    """
    x = F.col(vector_col).cast("array<double>")
    scaled = F.transform(x, lambda c: F.floor(c * SCALE))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT / SCALE))
    # The width is checked first: components of other rows are not looked at.
    fits = F.when(x.isNull() | (F.size(x) != width), F.lit(False)).otherwise(usable)
    return vectors.where(fits).select(F.col(id_col).cast("long").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``; of equal ids the lesser vector first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the closest other one, never too large."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    between = distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    return np.sqrt(between.min(1)) / 2 * (1 - _MARGIN)


def assign_batch(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New clusters, both bounds, and which rows were scanned in full; a cluster of -1 is not known yet."""
    cluster, known = cluster.copy(), cluster >= 0
    most = int(drift.argmax())
    second = np.delete(drift, most).max() if len(drift) > 1 else 0.0
    own = np.where(known, cluster, 0)
    upper = np.where(known, upper + drift[own], np.inf)
    # The others drift at most as far as the farthest that is not the vector's own.
    lower = np.where(known, lower - np.where(own == most, second, drift[most]), -np.inf)
    threshold = np.maximum(gaps[own], lower)
    unsure = np.flatnonzero(~(upper < threshold))
    # One exact distance may settle it.
    tight = unsure[known[unsure]]
    upper[tight] = np.sqrt(((v[tight] - centroids[cluster[tight]]) ** 2).sum(1)) * (1 + _MARGIN)
    unsure = unsure[~(upper[unsure] < threshold[unsure])]
    if len(unsure):
        d = distances(v[unsure], centroids)
        cluster[unsure] = d.argmin(1)  # the first of equal ones
        ordered = np.sort(d, 1)
        upper[unsure] = np.sqrt(ordered[:, 0]) * (1 + _MARGIN)
        lower[unsure] = np.sqrt(ordered[:, 1]) * (1 - _MARGIN) if d.shape[1] > 1 else np.inf
    scanned = np.zeros(len(v), bool)
    scanned[unsure] = True
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    gaps, width = _gaps(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(2)
            old = before.to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, upper, lower, scanned = assign_batch(_matrix(batch.column(1), width), old, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)), centroids, gaps, drift)
            scans = batch.column(6).to_numpy(zero_copy_only=False) + scanned
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), before, pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], names=batch.schema.names)

    return state.mapInArrow(run, _STATE)


def _changes(moved: DataFrame, k: int, width: int) -> DataFrame:
    """``at, place, change``: by how much each cluster's count (place 0) and sums change; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width)
            counted = np.concatenate([np.ones((len(v), 1), np.int64), v], 1)
            for column, sign in ((1, 1), (2, -1)):
                at = batch.column(column).to_numpy()
                np.add.at(total, at[at >= 0], sign * counted[at >= 0])
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(total[at, place])], names=["at", "place", "change"])

    return moved.mapInArrow(run, "at int, place int, change long").groupBy("at", "place").agg(F.sum("change").alias("change"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, full_scans`` for each usable vector.

    Which vectors are usable: see ``integer_vectors``.  Every row counts, also
    of repeated or null ids; ties go to the smaller number of centroid.  With
    fewer than ``k`` vectors there are as many centroids; without any, no rows.
    Empty clusters keep their centroid.  ``distance`` is squared;
    ``full_scans`` tells how often a vector was compared with all centroids.
    """
    usable = integer_vectors(vectors, width, id_col, vector_col)
    start = usable.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("full_scans"))
    state = staged(start, "vectors")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        none = "0 AS cluster, 0L AS distance, 0L AS cluster_inertia, 0L AS inertia, '' AS centroid_sha256, 0 AS full_scans".split(", ")
        return state.where("false").selectExpr("vec_id", *none)
    sums = [[0] * (width + 1) for _ in centroids]
    drift = np.zeros(len(centroids))
    for step in range(rounds + 1):
        fresh = staged(_assigned(state, centroids, drift), "assigned")
        drop(state)
        state = fresh
        if step == rounds:
            break
        # Exact sums change by the vectors that came and went.
        changes = _changes(state.where("cluster <> before").select("v", "cluster", "before"), len(centroids), width)
        for at, place, change in changes.collect():
            sums[at][place] += change
        before, centroids = centroids, np.array([[x // n for x in parts] if n else list(c) for c, (n, *parts) in zip(centroids.tolist(), sums, strict=True)], np.int64)
        drift = np.sqrt(((centroids - before) ** 2).sum(1)) * (1 + _MARGIN)
    return _result(state, centroids)


def _result(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Exact distances to the final centroids, and what holds for each cluster, joined back by at most ``k`` rows."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    final = F.from_json(F.lit(str(centroids.tolist())), "array<array<long>>")
    squares = F.zip_with(F.col("v"), F.get(final, F.col("cluster")), lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    measured = state.select("vec_id", "cluster", F.aggregate(squares, F.lit(0).cast("long"), lambda t, x: t + x).alias("distance"), "full_scans")
    by_cluster = measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    facts = [(int(r.cluster), int(r.s), sum(int(x.s) for x in by_cluster), names[r.cluster]) for r in by_cluster]
    known = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "full_scans")

"""Centroid clustering of integer vectors with Elkan's bounds.

A vector keeps an upper bound of the distance to its centroid and a lower bound of
the distance to each. When centroids have moved, bounds move with them; a distance
is calculated only where the bounds, and the distances among the centroids, leave
it open. Bounds are floats rounded away from the truth and a centroid is ruled out
only where it is strictly farther, so ties reach the exact integer distances, by
which all is decided.

Vectors are never shuffled: a round reads the table of vectors and bounds, assigns
in NumPy and writes the next one; sums of 64 components in 16 clusters are added up
before they are exchanged. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphline.llm.common import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components up to here have squared distances and sums that fit a long.
LARGEST = 1 << 27

STATE = "vec_id long, vector array<int>, cluster int, upper float, lower array<float>, distance long, calculations int"
#: Squared distances below 2^53 are exact as doubles; larger ones are rounded once.
UP, DOWN = np.float32(np.inf), np.float32(0)


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the vectors of exactly ``dimensions`` components, none null or non-finite, as integers floor(scale * x)."""
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where((F.size(values) == dimensions) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(values, lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}"))).cast("int")).alias("vector"),
    )


def _above(squared: np.ndarray) -> np.ndarray:
    """Floats that aren't below the roots of integers."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf).astype(np.float32), UP)


def _below(squared: np.ndarray) -> np.ndarray:
    """Floats that aren't above the roots of integers."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), 0).astype(np.float32), -UP), DOWN)


class Centroids:
    """Centroids of a round: integers, what they moved since the last one, and half the distances among them."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        self.moved = _above(((now - (now if before is None else before)) ** 2).sum(1))
        self.half = _below(((now[:, None, :] - now[None, :, :]) ** 2).sum(2)) / np.float32(2)
        away = self.half + np.where(np.eye(len(now), dtype=bool), UP, DOWN)
        self.nearest = away.min(1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, upper and lower bounds after this round, and how many distances each vector took. A cluster below 0 is unknown."""
        n, k = len(x), len(self.now)
        known = cluster >= 0
        cluster = np.where(known, cluster, 0)
        upper = np.where(known, np.nextafter(upper + self.moved[cluster], UP), UP)
        lower = np.maximum(np.nextafter(lower - self.moved, -UP), DOWN)
        took, best = np.zeros(n, np.int32), np.full(n, -1, np.int64)

        def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            took[rows] += 1
            return ((x[rows] - self.now[to]) ** 2).sum(1)

        for c in range(k):
            rows = np.flatnonzero((cluster != c) & (upper >= self.nearest[cluster]) & (upper >= lower[:, c]) & (upper >= self.half[cluster, c]))
            loose = rows[best[rows] < 0]
            if len(loose):  # the upper bound may be too high: take the exact distance first
                best[loose] = distance(loose, cluster[loose])
                upper[loose] = _above(best[loose])
                lower[loose, cluster[loose]] = _below(best[loose])
                rows = rows[(upper[rows] >= lower[rows, c]) & (upper[rows] >= self.half[cluster[rows], c])]
            if not len(rows):
                continue
            found = distance(rows, np.full(len(rows), c))
            lower[rows, c] = _below(found)
            better = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
            rows, found = rows[better], found[better]
            cluster[rows], best[rows], upper[rows] = c, found, _above(found)
        return cluster, upper, lower, took


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _round(state: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """The state after one more assignment; the last one has exact distances instead of bounds."""
    k = len(centroids.now)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                n = batch.num_rows
                x = np.asarray(batch.column(1).flatten(), np.int64).reshape(n, -1)
                cluster, upper = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.float32)
                lower = np.array(batch.column(4).flatten(), np.float32).reshape(n, k)
                cluster, upper, lower, took = centroids.assign(x, cluster, upper, lower)
                distance, kept = np.zeros(n, np.int64), lower
                if last:
                    distance, kept = ((x - centroids.now[cluster]) ** 2).sum(1), lower[:, :0]
                bounds = _lists(kept, pa.float32()) if kept.shape[1] else pa.array([[]] * n, pa.list_(pa.float32()))
                vectors = pa.array([[]] * n, pa.list_(pa.int32())) if last else batch.column(1)
                took = took + np.asarray(batch.column(6), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), bounds, pa.array(distance), pa.array(took, pa.int32())], [c.split(" ")[0] for c in STATE.split(", ")])

    return stored(state.mapInArrow(assign, STATE), "vectors")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, in order; a null vec_id counts as empty, ties go by components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("hash"), "vector").orderBy("hash", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact means; centroids without vectors stay."""
    sums = [F.sum(F.get("vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(before.shape[1])]
    after = before.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each cluster
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(before.shape[1])]
    return after


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, calculations) of each vector, and the centroids.

    ``calculations`` says how many distances were calculated for the vector over all
    rounds. Null vectors and those of another length, with nulls or non-finite
    components, are left out. Fewer vectors than clusters make as many clusters as
    vectors; no vectors make none and an empty table. Rows of one vec_id are rows
    each, and equal vectors are in one cluster, the smaller number in a tie. Further
    columns are ignored. Components beyond 2^27 after scaling raise an error: their
    distances would not fit a long.
    """
    vectors = integer_vectors(embeddings, dimensions)
    now = first_centroids(vectors, clusters, seed)
    bounds = [F.lit(-1).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), F.array_repeat(F.lit(0).cast("float"), len(now)).alias("lower")]
    state = vectors.select("vec_id", "vector", *bounds, F.lit(0).cast("long").alias("distance"), F.lit(0).alias("calculations"))
    if not len(now):
        return state.select("vec_id", "cluster", "distance", "calculations"), now
    before = None
    for _ in range(rounds):
        state = _round(state, Centroids(now, before), last=False)
        before, now = now, _means(state, now)
    return _round(state, Centroids(now, before), last=True).select("vec_id", "cluster", "distance", "calculations"), now


def report(embeddings: DataFrame, **options: int) -> DataFrame:
    """``cluster`` with cluster_inertia and inertia (sums of distances) and the centroid_sha256 of the vector's centroid."""
    found, centroids = cluster(embeddings, **options)
    spark = embeddings.sparkSession
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each cluster
    rows = [(c, total, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in inertia.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

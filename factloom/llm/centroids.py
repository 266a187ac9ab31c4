"""Centroid clustering whose assignment step is the threshold algorithm.

Every dimension has a list of the centroids sorted by their component. A vector enters
each list at its own component and walks outward, always to the nearer side. All
centroids met are compared exactly. A centroid that no list has given yet is at least
as far as the sum of the squared gaps to the next entries of all lists, so the walk
ends when this sum exceeds the best distance. Everything is counted in integers, so
results do not depend on the order of rows or on how they are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, pick
from factloom.session import materialise

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
# Vectors that walk side by side.
SIDE_BY_SIDE = 512


def largest_component(dimensions: int) -> int:
    """Components up to this size have squared distances that fit a long."""
    return isqrt((1 << 62) // dimensions) // 2


class Centroids:
    """Sorted lists of centroid components, one per dimension, and the walk over them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.argsort(points, axis=0, kind="stable")
        self.values = np.take_along_axis(points, self.order, 0)
        self.none = 2 * largest_component(points.shape[1]) + 1

    def _gaps(self, vectors: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the next entries on both sides are; a side without entries is farther than any other."""
        last, dims = len(self.values) - 1, np.arange(vectors.shape[1])
        below = vectors - self.values[np.maximum(left, 0), dims]
        above = self.values[np.minimum(right, last), dims] - vectors
        return np.where(left < 0, self.none, below), np.where(right > last, self.none, above)

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, dims = vectors.shape
        clusters = len(self.points)
        right = np.empty((count, dims), dtype=np.int64)
        for dim in range(dims):
            right[:, dim] = np.searchsorted(self.values[:, dim], vectors[:, dim])
        left = right - 1
        distances = np.full((count, clusters), np.iinfo(np.int64).max)
        seen = np.zeros((count, clusters), dtype=bool)
        active = np.arange(count)
        while len(active):
            own, lo, hi = vectors[active], left[active], right[active]
            below, above = self._gaps(own, lo, hi)
            frontier = np.minimum(below, above)
            bound = np.einsum("nd,nd->n", frontier, frontier)
            going = (bound <= distances[active].min(axis=1)) & ~seen[active].all(axis=1)
            active, lo, hi = active[going], lo[going], hi[going]
            down = (below <= above)[going]
            met = self.order[np.where(down, lo, hi), np.arange(dims)]
            left[active], right[active] = lo - down, hi + ~down
            fresh = np.zeros((len(active), clusters), dtype=bool)
            fresh[np.arange(len(active))[:, None], met] = True
            fresh &= ~seen[active]
            seen[active] |= fresh
            at, centroid = np.nonzero(fresh)
            apart = vectors[active[at]] - self.points[centroid]
            distances[active[at], centroid] = np.einsum("nd,nd->n", apart, apart)
        nearest = distances.argmin(axis=1)
        return nearest, distances[np.arange(count), nearest]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller one of equally near ones) and squared distance of each vector."""
        parts = [self._walk(vectors[low : low + SIDE_BY_SIDE]) for low in range(0, len(vectors), SIDE_BY_SIDE)]
        return np.concatenate([near for near, _ in parts]), np.concatenate([far for _, far in parts])

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, point)).encode()).hexdigest() for point in self.points.tolist()]


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): vectors of the right length as integers floor(scale * x)."""
    bound = F.lit(float(largest_component(dimensions)))

    def fits(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= bound)

    raw = F.col("raw")
    usable = F.coalesce((F.size(raw) == dimensions) & F.forall(raw, fits), F.lit(False))
    return (
        pick(vectors, id_col, vector_col).toDF("id", "raw")
        .where(usable)
        .select("id", F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vector"))
    )


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors with the smallest SHA-256 of ``seed:id`` in order; equal hashes by components."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(code.alias("code"), "vector").orderBy("code", "vector").limit(clusters).collect()
    return np.array([row["vector"] for row in rows], dtype=np.int64)


def cluster_sums(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, n, sums): one row per non-empty cluster. A task gives one row per cluster, whatever it read."""
    dimensions, clusters = centroids.points.shape[1], len(centroids.points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((clusters, dimensions), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["vector"].to_numpy()).astype(np.int64)
                near, _ = centroids.assign(vectors)
                np.add.at(sums, near, vectors)
                n += np.bincount(near, minlength=clusters)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": list(sums[some])})

    parts = kept.select("vector").mapInPandas(run, "cluster int, n long, sums array<long>")
    places = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimensions)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *places).select(
        "cluster", "n", F.array(*[f"s{i}" for i in range(dimensions)]).alias("sums")
    )


def clusters_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2,
                dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Kept are vectors of exactly ``dimensions`` components, none of them null or not
    finite; a component x becomes floor(scale * x). Vectors with a component beyond
    ``largest_component`` (2^27 for 64 dimensions) are not kept: their distances need
    not fit a long. The ``clusters`` vectors with the smallest hash of their id are the
    first centroids; with fewer vectors there are as many centroids as vectors. A null
    id hashes as an empty one. Repeated rows and ids are vectors of their own, and equal
    vectors may be centroids more than once: then the first of them gets all rows and the
    others keep their place. Of equally near centroids the one with the smaller number
    counts. An inertia that does not fit a long is null. An empty table, or one without
    kept vectors, gives an empty result; other columns are ignored.

    The vectors stay distributed. A round moves one row per task and cluster; the driver
    holds ``clusters`` centroids and no vectors.
    """
    bounded_batches(vectors.sparkSession)
    kept = materialise(kept_vectors(vectors, dimensions, scale, id_col, vector_col), "cluster-vectors")
    points = first_centroids(kept, clusters, seed).reshape(-1, dimensions)
    if len(points):
        for _ in range(rounds):
            moved = points.copy()
            for row in cluster_sums(kept, Centroids(points)).collect():
                moved[row["cluster"]] = [total // row["n"] for total in row["sums"]]
            points = moved
    centroids = Centroids(points) if len(points) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near, far = centroids.assign(np.stack(batch["vector"].to_numpy()).astype(np.int64))
                yield pd.DataFrame({"id": batch["id"], "cluster": near.astype(np.int32), "distance": far})

    id_type = kept.schema["id"].dataType.simpleString()
    assigned = materialise(kept.mapInPandas(run, f"id {id_type}, cluster int, distance long"), "clusters")
    sizes = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertia = assigned.agg(F.try_sum("distance")).first()[0]
    final = vectors.sparkSession.createDataFrame(
        [(i, *pair) for i, pair in enumerate(zip(centroids.digests(), points.tolist(), strict=True))] if centroids else [],
        "cluster int, centroid_sha256 string, centroid array<long>",
    )
    # One row per cluster: as small as the list of centroids.
    described = F.broadcast(sizes.join(F.broadcast(final), "cluster"))
    out = assigned.join(described, "cluster").withColumn("inertia", F.lit(inertia).cast("long"))
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from helpers import clashing

from factloom.llm import centroids
from factloom.llm.centroids import Centroids, clusters_of


def brute_force(rows, clusters, rounds, seed, dims, scale=256):
    """Lloyd's rounds in plain Python integers."""
    kept = []
    for key, vector in rows:
        if vector is None or len(vector) != dims or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(x * scale) for x in vector]))

    def code(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()

    points = [vector for _, vector in sorted(kept, key=lambda row: (code(row), row[1]))[:clusters]]

    def nearest(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, p, strict=True)), i) for i, p in enumerate(points))

    for _ in range(rounds):
        near = [nearest(vector)[1] for _, vector in kept]
        for i in range(len(points)):
            own = [vector for (_, vector), at in zip(kept, near, strict=True) if at == i]
            if own:
                points[i] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(key, *nearest(vector)) for key, vector in kept]
    total = sum(far for _, far, _ in found)
    sums = {i: sum(far for _, far, at in found if at == i) for i in range(len(points))}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted([(key, at, far, sums[at], total, sha[at]) for key, far, at in found], key=repr)


def found_rows(df):
    return sorted([tuple(row)[:6] for row in df.collect()], key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize(("spread", "seed"), [(1.0, 1), (0.02, 2), (300.0, 3)])
def test_walk_equals_all_distances(spread, seed):
    draw = np.random.default_rng(seed)
    points = np.floor(draw.normal(0, spread, (23, 7)) * 16).astype(np.int64)
    points[5] = points[3]
    vectors = np.floor(draw.normal(0, spread, (1500, 7)) * 16).astype(np.int64)
    vectors[:23] = points
    all_far = ((vectors[:, None, :] - points[None]) ** 2).sum(axis=2)
    near, far = Centroids(points).assign(vectors)
    assert (near == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()


def test_walk_stops_early():
    """Far apart groups: the walk ends before it has met every centroid."""
    points = np.repeat(np.arange(0, 4000, 100)[:, None], 4, axis=1).astype(np.int64)
    centroids_ = Centroids(points)
    met = []
    whole = centroids_._gaps
    centroids_._gaps = lambda *a: met.append(len(a[0])) or whole(*a)
    centroids_.assign(points + 3)
    assert len(met) <= 3


def test_equals_brute_force(spark):
    draw = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 1, 6))]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (900, rows[3][1])]
    found = clusters_of(frame(spark, rows).repartition(5), clusters=12, rounds=4, seed=2, dimensions=6)
    assert found_rows(found) == brute_force(rows, 12, 4, 2, 6)


def test_odd_rows(spark):
    big = float(1 << 40)
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 0.0]), (8, [1.0, 2.0, 3.0]), (None, [0.0, 0.0]), (9, [-0.001, 0.001]), (1, [1.0, 2.0])]
    found = clusters_of(clashing(frame(spark, [*rows, (10, [big, 0.0]), (11, [0.0, -1e300])], "double")), clusters=3, dimensions=2)
    assert found_rows(found) == brute_force(rows, 3, 5, 2, 2)


def test_hot_vector(spark):
    """A third of all rows are one vector: tasks still give one row per cluster."""
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else [i / 7, -i / 5, i % 11 / 3]) for i in range(600)]
    vectors = frame(spark, rows, "double").repartition(6)
    assert found_rows(clusters_of(vectors, clusters=9, dimensions=3)) == brute_force(rows, 9, 5, 2, 3)
    kept = centroids.kept_vectors(vectors, 3, 256, "vec_id", "embedding")
    assert sum(row["n"] for row in centroids.cluster_sums(kept, Centroids(np.zeros((2, 3), dtype=np.int64))).collect()) == 600


def test_empty(spark):
    for rows in ([], [(1, None)]):
        found = clusters_of(frame(spark, rows))
        assert found.count() == 0 and found.columns[:3] == ["vec_id", "cluster", "distance"]

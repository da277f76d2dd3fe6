import hashlib

import numpy as np
import pytest

from docquery.llm.clustering import bisectors, clustered, integers, op12_clustering, tournament

SCHEMA = "vec_id long, vector array<double>, cluster int, distance string"


def brute(points, k, rounds, seed="2"):
    """Plain assignment to the least (distance, number), Python integers all through."""
    order = sorted((i for i, _ in points if i is not None), key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    held = dict(points)
    centroids = [list(held[i]) for i in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, v in points:
            of.setdefault(nearest(v)[1], []).append(v)
        for j, members in of.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in points], centroids


def test_tournament_is_the_least_distance_and_number():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-3, 4, (12, 3))
    centroids[7] = centroids[2]
    points = rng.integers(-4, 5, (5000, 3))
    far = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (tournament(points, *bisectors(centroids)) == far.argmin(axis=1)).all()
    assert (far.min(axis=1)[:, None] == far).sum(axis=1).max() > 1


def test_rounds_match_plain_ones_with_ties_copies_and_empty_centroids(spark):
    rng = np.random.default_rng(4)
    points = [(i, tuple(int(x) for x in rng.integers(-2, 3, 4))) for i in range(300)] + [(300 + i, (1, 1, 1, 1)) for i in range(200)]
    rows = spark.createDataFrame([(i, [x / 256 for x in v], 9, "clash") for i, v in points], SCHEMA).repartition(5)
    want, centroids = brute(points, 9, 4)
    assigned, clusters = clustered(rows, k=9, rounds=4, dimension=4)
    assert sorted(map(tuple, assigned.collect())) == sorted(want)
    for r in clusters.collect():
        mine = [d for _, c, d in want if c == r.cluster]
        assert (r.n, r.cluster_inertia, r.inertia, r.centroid) == (len(mine), sum(mine), sum(d for *_, d in want), centroids[r.cluster])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e9, 1.0]), (8, [0.0, -0.0]), (None, [2.0, 2.0])], "vec_id long, vector array<double>")
    assert sorted((r.vec_id or 0, r.vector) for r in integers(rows, 2).collect()) == [(0, [512, 512]), (1, [128, -1]), (8, [0, 0])]
    assigned, _ = clustered(rows, k=2, rounds=1, dimension=2)
    assert {r.vec_id for r in assigned.collect()} == {None, 1, 8}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = spark.createDataFrame([(1 << 60 | i, [float(i), 0.0]) for i in range(n)], "vec_id long, vector array<float>")
    assigned, clusters = clustered(rows, dimension=2)
    assert {(r.vec_id, r.distance) for r in assigned.collect()} == {(1 << 60 | i, 0) for i in range(n)}
    assert clusters.count() == n


def test_repeated_ids_and_vectors_count_each(spark):
    rows = spark.createDataFrame([(1, [1.0, 1.0])] * 3 + [(1, [9.0, 9.0])], "vec_id long, vector array<double>")
    assigned, clusters = clustered(rows, k=2, rounds=2, dimension=2)
    assert assigned.count() == 4 and sum(r.n for r in clusters.collect()) == 4


def test_query_columns(spark, sf):
    found = op12_clustering(spark, sf)
    assert dict(found.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert found.count() == found.select("vec_id").distinct().count() > 0

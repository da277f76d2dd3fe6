"""Centroid clustering in exact integers, each vector's nearest centroid found by a tournament of bisectors.

For centroids i < j the sign of x . 2(c_j - c_i) - (|c_j|^2 - |c_i|^2) tells
which of them is nearer to x. The integer normals and thresholds of all pairs
are computed once per round; a vector meets the centroids in their order, and
each of its k - 1 linear tests eliminates one. A sign of zero favours the
smaller number, so the survivor is the least of (distance, number). Only the
survivor's distance is computed, exactly.

A round reads the vectors once where they lie: a task gives its sums and counts
per centroid, and k rows of sums are all that moves. The driver holds the k
centroids, whatever the number of vectors.

Vectors that are null, of another dimension, or with null or non-finite
components take no part; neither do those with a component beyond LARGEST,
whose squared distances might not fit a long. Rows that repeat an id or a
vector count each. Rows without id are clustered, and become first centroids
only after all others; equal hashes go to the smaller vector. Of fewer vectors
than k each is a centroid; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.batches import map_rows
from docquery.llm.storage import written

CENTROIDS, ROUNDS, DIMENSION, SCALE, SEED = 40, 5, 64, 256, "2"
#: Largest component that takes part; up to it 64 squared differences fit a long, as do 2**36 sums. Vectors that are tested together.
LARGEST, TOGETHER = 1 << 27, 2048
ASSIGNED, SUMS = "vec_id long, cluster int, distance long", "cluster int, n long, sums array<long>"
CLUSTERS = "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>"


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (k, k, d) and thresholds (k, k): x is nearer to j than to i where normals[i, j] . x > thresholds[i, j]."""
    squares = (centroids**2).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def tournament(points: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, the smaller number of equals."""
    best = np.zeros(len(points), np.int64)
    for begin in range(0, len(points), TOGETHER):
        part, winner = points[begin : begin + TOGETHER], best[begin : begin + TOGETHER]
        for rival in range(1, len(thresholds)):
            side = np.einsum("ij,ij->i", normals[winner, rival], part) - thresholds[winner, rival]
            winner[side > 0] = rival
    return best


def _sums(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[pd.DataFrame]:
    """One row per centroid that a task's vectors are nearest to."""
    tests = bisectors(centroids)
    n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for batch in batches:
        if len(batch):
            points = np.stack(batch["vector"].to_numpy()).astype(np.int64)
            cluster = tournament(points, *tests)
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(sums, cluster, points)
    held = np.flatnonzero(n)
    if len(held):
        yield pd.DataFrame({"cluster": held.astype(np.int32), "n": n[held], "sums": pd.Series(list(sums[held]), dtype=object)})


def _assign(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[pd.DataFrame]:
    tests = bisectors(centroids)
    for batch in batches:
        if len(batch):
            points = np.stack(batch["vector"].to_numpy()).astype(np.int64)
            cluster = tournament(points, *tests)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "distance": ((points - centroids[cluster]) ** 2).sum(axis=1)})


def integers(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and vector of the vectors that take part, each component x as floor(scale * x)."""
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * float(scale) < float(LARGEST))
    kept = vectors.select("vec_id", "vector").where(F.col("vector").isNotNull() & (F.size("vector") == dimension) & F.forall("vector", fits))
    return kept.withColumn("vector", whole.cast("array<int>"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the least hashes."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), "UTF-8"), 256)
    rows = points.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of the vectors nearest to it; empty ones stay."""
    of_tasks = points.select("vector").mapInPandas(functools.partial(_sums, centroids=centroids), SUMS)
    each = of_tasks.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in each.collect():
        out[r.cluster, r["at"]] = r.s // r.n
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every vector that takes part, and (cluster, n, cluster_inertia, inertia of all, centroid) of the clusters that have any."""
    spark = vectors.sparkSession
    points = written(integers(vectors, dimension, scale), "cluster-points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED), spark.createDataFrame([], CLUSTERS)
    for _ in range(rounds):
        centroids = moved(points, centroids)
    assigned = written(map_rows(points, functools.partial(_assign, centroids=centroids), ASSIGNED, "vec_id"), "cluster-assigned")
    sizes = {r.cluster: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}  # k rows
    total = sum(r.inertia for r in sizes.values())
    return assigned, spark.createDataFrame([(i, r.n, r.inertia, total, centroids[i].tolist()) for i, r in sizes.items()], CLUSTERS)


def centroid_sha256(centroid: str) -> Column:
    return F.sha2(F.encode(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), "UTF-8"), 256)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    assigned, clusters = clustered(vectors)
    facts = clusters.select("cluster", "cluster_inertia", "inertia", centroid_sha256("centroid").alias("centroid_sha256"))
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows

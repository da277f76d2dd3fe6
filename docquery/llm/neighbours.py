"""Approximate nearest neighbours by collision-counting hashing.

Vectors are indexed in blocks: a sorted array per random projection. For a
query, windows centred on its own projections grow (virtual rehashing: a wider
window is a coarser hash, without new hash tables); a vector that falls into
the windows of enough projections is verified by its true distance. Equal
vectors of a block are indexed and verified as one. Windows stop growing when
the block has given enough verified vectors and are so wide that a vector
nearer than the k-th best would have collided: copies and near copies collide
together and could use up the number alone. The best of all blocks are the
answer. Every vector is indexed in full; nothing is fitted.

Blocks of vectors meet blocks of queries, so that a task holds BLOCK vectors
and QUERY_BLOCK queries however many there are.

Vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors meet those of the same dimension only. Rows that repeat a
vec_id are candidates each; as a query such an id counts once, with its least
vector.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, SEED = 8192, 1024, 5
#: Projections; share of them that must collide; share of a block and least number of vectors to verify; growth of the windows.
PROJECTIONS, COLLIDING, VERIFIED, LEAST_VERIFIED, GROWTH = 64, 0.6, 0.15, 512, 1.25
#: Times that windows grow, before they take all; their reach in distances of the k-th best, into which a projection of a vector as far away falls with probability 0.7.
STEPS, SURE = 24, 1.04


def usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def block_neighbours(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, verified: float = VERIFIED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, distances) of the k nearest verified points of one block, per query."""
    points, of, copies = np.unique(points + 0.0, axis=0, return_inverse=True, return_counts=True)
    of = of.ravel()
    members, first = ids[np.lexsort((ids, of))], np.cumsum(copies) - copies
    lines = np.random.Generator(np.random.PCG64(SEED)).standard_normal((points.shape[1], PROJECTIONS))
    hashes, asked = points @ lines, queries @ lines
    order = np.argsort(hashes, axis=0, kind="stable").T.astype(np.int32)
    ranked = np.ascontiguousarray(np.take_along_axis(hashes.T, order, axis=1))
    n = len(points)
    enough = min(n, max(int(k + verified * len(ids)), LEAST_VERIFIED))
    threshold = int(np.ceil(COLLIDING * PROJECTIONS))
    spread = float(hashes.std()) or 1.0
    reaches = np.append(0.3 * spread * GROWTH ** np.arange(STEPS), np.inf)
    edges = np.concatenate((-reaches[::-1], [0.0], reaches))
    windows = np.stack([np.searchsorted(line, at[:, None] + edges).astype(np.int32) for line, at in zip(ranked, asked.T, strict=True)], axis=1)
    out = []
    for own, q, window in zip(query_ids, queries, windows, strict=True):
        count = np.zeros(n, np.int32)
        others = copies - np.bincount(of[ids == own], minlength=n)
        squares = np.full(n, np.nan)
        for step, reach in enumerate(reaches):
            wider = window[:, [STEPS - step, STEPS - step + 1, STEPS + step + 1, STEPS + step + 2]].tolist()
            parts = [part for line, (a, b, c, d) in zip(order, wider, strict=True) for part in (line[a:b], line[c:d])]
            count += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            hit = np.flatnonzero((count >= threshold) & (others > 0))
            every = all(a == 0 and d == n for a, _, _, d in wider)
            if len(hit) >= enough or every:
                new = hit[np.isnan(squares[hit])]
                squares[new] = np.cumsum((points[new] - q) ** 2, axis=1)[:, -1]
                near = hit[np.argsort(squares[hit], kind="stable")]
                place = np.searchsorted(np.cumsum(others[near[:k]]), k)
                if every or (place < min(k, len(near)) and reach >= SURE * np.sqrt(squares[near[place]])):
                    break
        if place < len(near):
            near = near[squares[near] <= squares[near[place]]]
        found = np.concatenate([members[first[j] : first[j] + copies[j]] for j in near] or [members[:0]])
        far = np.repeat(squares[near], copies[near])[found != own]
        found = found[found != own]
        best = np.lexsort((found, far))[:k]
        out.append((found[best], np.sqrt(far[best])))
    return out


def _block(left: pd.DataFrame, right: pd.DataFrame, k: int, verified: float) -> pd.DataFrame:
    columns = ["query_id", "vec_id", "score"]
    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in columns})
    stack = lambda rows: np.stack([np.asarray(v, np.float64) for v in rows])
    own = right["query_id"].to_numpy(np.int64)
    found = block_neighbours(left["vec_id"].to_numpy(np.int64), stack(left["vector"]), own, stack(right["vector"]), k, verified)
    return pd.DataFrame({"query_id": np.repeat(own, [len(i) for i, _ in found]), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, verified: float = VERIFIED, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; vectors and queries have vec_id and vector."""
    points = vectors.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & usable("vector")).withColumn("width", F.size("vector"))
    asked = queries.where(F.col("vec_id").isNotNull() & usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("width"))
    blocks, query_blocks = (max(1, -(-frame.count() // size)) for frame, size in ((points, block), (asked, QUERY_BLOCK)))
    spread = lambda name, n: F.pmod(F.xxhash64(name, "vector"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["width", "block", "part"]
    points = points.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))).withColumn("part", every(query_blocks))
    asked = asked.withColumn("part", spread("query_id", query_blocks)).withColumn("block", every(blocks))
    found = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(functools.partial(_block, k=k, verified=verified), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))

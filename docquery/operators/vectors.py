"""Embeddings, the vector table, and exact top-k search within workspaces."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import let, strip

#: Hits per query; digits of a score in which ties are ties.
TOP_K, DIGITS = 5, 12
#: Bytes of points, and of queries, that a task compares at most: whoever has many parts of queries moves the points as often.
SPLIT_BYTES, ASKED_BYTES = 64 << 20, 16 << 20
#: Points and queries of a part where their bytes are not known.
SPLIT_POINTS, SPLIT_QUERIES = 50_000, 4096
#: Scores held at once, and queries in a step; cells are compared together where at least this share of them is wanted.
SCORES, QUERY_STEP, DENSE = 1 << 20, 512, 0.25
BLOCK_HITS = "query_id long, workspace_id long, point_id long, score double, tied double"


class EmbeddingProvider(Protocol):
    """Adds a column `vector` for a text column; passages and queries may differ."""

    def passages(self, df: DataFrame, text: str) -> DataFrame: ...

    def queries(self, df: DataFrame, text: str) -> DataFrame: ...


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """Unit length; null for zero vectors."""
    return let(vector, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))))


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class HashEmbedder:
    """Counts of hashed lower-case words, scaled to unit length; works offline and inside Catalyst."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def _with(self, df: DataFrame, text: Column) -> DataFrame:
        words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
        buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % self.dimension).cast("int"))
        # one of each bucket more: runs of the sorted buckets are then the counts in order, at a cost that hangs on words alone
        padded = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(self.dimension - 1))))
        starts = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)))
        counts = let(padded, lambda s: let(starts(s), lambda a: F.transform(a, lambda x, j: (F.coalesce(F.get(a, j + 1), F.size(s)) - x - 1).cast("double"))))
        return df.withColumn("vector", normalised(counts))

    def passages(self, df: DataFrame, text: str) -> DataFrame:
        return self._with(df, F.concat(F.lit("passage: "), strip(F.col(text))))

    def queries(self, df: DataFrame, text: str) -> DataFrame:
        return self._with(df, F.concat(F.lit("query: "), strip(F.col(text))))


class ModelEmbedder:
    """A sentence-transformer model, loaded once per worker; needs that package on the executors. A null text has no vector."""

    def __init__(self, model: str, dimension: int = 768, batch: int = 32):
        self.model, self.dimension, self.batch = model, dimension, batch

    def _with(self, df: DataFrame, text: str, prefix: str) -> DataFrame:
        model, batch, dimension = self.model, self.batch, self.dimension

        @F.pandas_udf("array<double>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer

            loaded = SentenceTransformer(model)
            for texts in parts:
                there = texts.notna()
                out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
                if there.any():
                    found = loaded.encode([prefix + t.strip() for t in texts[there]], batch_size=batch, normalize_embeddings=True)
                    if found.shape[1] != dimension:
                        raise ValueError(f"embedding dimension mismatch: expected {dimension}, got {found.shape[1]}")
                    out[there] = list(found.astype("float64"))
                yield out

        return df.withColumn("vector", run(F.col(text)))

    def passages(self, df: DataFrame, text: str) -> DataFrame:
        return self._with(df, text, "passage: ")

    def queries(self, df: DataFrame, text: str) -> DataFrame:
        return self._with(df, text, "query: ")


def latest(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the last by `order`, where a null comes first; of equals, or without an order, the one with the largest hash. Rows without key all stay."""
    by = F.struct(*([order] if order else []), F.xxhash64(*rows.columns))
    keyed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key of it")).agg(F.max_by(F.struct(*rows.columns), by).alias("row of it")).select("row of it.*")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def upserted(points: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """points with those of incoming in place of equal point_ids; of ids that incoming repeats the last one stays (see latest)."""
    new = latest(incoming, "point_id", order)
    return points.join(new.select("point_id"), "point_id", "left_anti").unionByName(new.select(points.columns))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as one array."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if vectors.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _steps(n: int, k: int, asked: int, starts: np.ndarray | None, wanted: np.ndarray | None, floor: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(queries, first point, last point + 1) to compare, of bounded size, small where a query has no k hits yet; with cells, none that no query wants."""

    def cut(rows: np.ndarray, a: int, z: int) -> Iterator[tuple[np.ndarray, int, int]]:
        most = max(1, SCORES // len(rows))
        size = min(most, max(64, 4 * k)) if np.isneginf(floor[rows]).any() else most
        while a < z:
            yield rows, a, min(z, a + size)
            a, size = a + size, min(most, 2 * size)

    groups = [np.arange(i, min(asked, i + QUERY_STEP)) for i in range(0, asked, QUERY_STEP)]
    if wanted is None:
        for rows in groups:
            yield from cut(rows, 0, n)
    elif wanted.mean() < DENSE:  # cell by cell, for the queries that want it
        for cell in range(len(starts) - 1):
            rows = np.flatnonzero(wanted[:, cell])
            for i in range(0, len(rows), QUERY_STEP):
                yield from cut(rows[i : i + QUERY_STEP], starts[cell], starts[cell + 1])
    else:  # several cells at once, for the queries that want any of them
        for rows in groups:
            for _, a, z in cut(rows, 0, n):
                first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, z, "left")
                some = rows[wanted[rows, first:last].any(axis=1)]
                if len(some):
                    yield some, a, z


def best_of_block(asked: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, least: np.ndarray | None = None, starts: np.ndarray | None = None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, place of the point, score, rounded score) of each query's k best points, as columns.

    Products in single precision, whose error is bounded, tell which points may
    be among the best so far; of those the scores are computed in double
    precision. With `least`, rounded scores below it are no hits. With cells
    (points starts[c] up to starts[c + 1]) a query meets at least those it wants
    (queries x cells), and others only where that costs nothing.
    """
    length = np.linalg.norm(asked, axis=1)
    reach = np.linalg.norm(points, axis=1).max(initial=0.0)
    kind = np.float32 if max(reach, length.max(initial=0.0)) < 1e15 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        slack = np.nan_to_num((points.shape[1] + 8) * np.finfo(kind).eps * length * reach, nan=np.inf) + 2 * 10.0**-DIGITS
    rough, rough_asked = points.astype(kind), asked.astype(kind)
    place, score, tied = np.full((len(asked), k), -1), np.zeros((len(asked), k)), np.full((len(asked), k), -np.inf)
    floor = np.full(len(asked), -np.inf) if least is None else least.astype(np.float64)
    some = max(1, (SCORES << 1) // max(1, points.shape[1]))
    for rows, a, z in _steps(len(points), k, len(asked), starts, wanted, floor):
        near = rough_asked[rows] @ rough[a:z].T >= (floor - slack)[rows, None].astype(kind)
        found = np.flatnonzero(near)
        for i in range(0, len(found), some):
            r, at = np.divmod(found[i : i + some], z - a)
            r, at = rows[r], at + a
            s = np.einsum("ij,ij->i", asked[r], points[at])
            t = np.round(s, DIGITS)
            last = place[r, -1]
            better = (t > tied[r, -1]) | (t == tied[r, -1]) & (ids[at] < ids[last]) & (last >= 0)
            better &= t >= floor[r]
            r, at, s, t = r[better], at[better], s[better], t[better]
            if not len(r):
                continue
            # the hits so far of the queries that have better ones, and those
            changed, of = np.unique(r, return_inverse=True)
            of = np.concatenate([np.repeat(np.arange(len(changed)), k), of])
            at, s, t = np.concatenate([place[changed].ravel(), at]), np.concatenate([score[changed].ravel(), s]), np.concatenate([tied[changed].ravel(), t])
            order = np.lexsort((np.where(at < 0, 0, ids[at]), -t, of))
            of, at, s, t = of[order], at[order], s[order], t[order]
            rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(changed)))[of]
            kept = rank < k
            to = changed[of[kept]], rank[kept]
            place[to], score[to], tied[to] = at[kept], s[kept], t[kept]
            floor[changed] = np.maximum(floor[changed], tied[changed, -1])
    query, rank = np.nonzero(place >= 0)
    return query, place[query, rank], score[query, rank], tied[query, rank]


def _block_hits(points: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    if not len(points) or not len(asked):
        return pa.table({"query_id": pa.array([], pa.int64()), "workspace_id": pa.array([], pa.int64()), "point_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "tied": pa.array([], pa.float64())})
    ids = points["point_id"].to_numpy()
    query, place, score, tied = best_of_block(matrix(asked["asked"]), ids, matrix(points["vector"]), k)
    return pa.table({"query_id": asked["query_id"].to_numpy()[query], "workspace_id": pa.array([asked["workspace_id"][0].as_py()] * len(query), pa.int64()), "point_id": ids[place], "score": score, "tied": tied})


def ranked(found: DataFrame, k: int, *kept: str) -> DataFrame:
    """The k best of the hits that blocks gave, with their rank; the rounded score only where it is to be kept."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tied"), "point_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop(*{"tied"} - set(kept))


def top_k(points: DataFrame, queries: DataFrame, k: int = TOP_K, split_points: int | None = None, split_queries: int | None = None) -> DataFrame:
    """query_id, workspace_id, point_id, score, rank: the k points of the query's workspace with the largest inner product (unit vectors: cosine).

    points (point_id, workspace_id, vector) and queries (query_id, workspace_id,
    vector); query_ids must not repeat. Scores equal to DIGITS digits tie, and
    ties go to the smaller point_id. Rows without id or workspace, and vectors
    that are null or hold what is no finite number, take no part; vectors meet
    those of their own length. A workspace's points are dealt into parts of
    SPLIT_BYTES (or of split_points points), and its queries into parts of
    ASKED_BYTES (or of split_queries queries); a pair of parts is one task,
    which hands on k hits of each query. Points are read twice, once for the
    sizes.
    """
    if k <= 0:
        raise ValueError("limit must be positive")
    held, wanted = points.where("point_id is not null and workspace_id is not null").where(finite("vector")), queries.where("query_id is not null and workspace_id is not null").where(finite("vector"))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    bytes_of = F.sum(F.size("vector").cast("long") * 8)
    load, limit = (F.count("*"), split_points) if split_points else (bytes_of, SPLIT_BYTES)
    asked_load, asked_limit = (F.count("*"), split_queries) if split_queries else (bytes_of, ASKED_BYTES)
    some = lambda n, size: F.greatest(blocks(n, size), F.lit(1))
    asked_of = wanted.groupBy("workspace_id").agg(some(asked_load, asked_limit).alias("asked_parts"))
    parts = some(load, limit).alias("parts")
    sizes = held.join(asked_of, "workspace_id", "left_semi").groupBy("workspace_id").agg(parts).join(asked_of, "workspace_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    width = F.size("vector").alias("width")
    left = held.join(sizes, "workspace_id").select("workspace_id", width, dealt("point_id", "parts").alias("part"), each("asked_parts").alias("asked_part"), "point_id", "vector")
    right = wanted.join(sizes, "workspace_id").select("workspace_id", width, each("parts").alias("part"), dealt("query_id", "asked_parts").alias("asked_part"), "query_id", F.col("vector").alias("asked"))
    keys = ["workspace_id", "width", "part", "asked_part"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(functools.partial(_block_hits, k=k), BLOCK_HITS), k)


def checked_queries(queries: DataFrame) -> DataFrame:
    """Adds error_code to questions that are blank or have no valid workspace."""
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    return queries.withColumn("error_code", F.when(blank | (F.coalesce("workspace_id", F.lit(0)) <= 0) | (F.length(strip(F.col("question"))) > 1000), "INVALID_INPUT"))

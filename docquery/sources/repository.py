"""A stored vector collection with exact search that reads few of its cells.

A workspace's points lie in cells around centroids (Lloyd rounds on a bounded
sample of the workspace, all points then to their nearest centroid), a Parquet
partition each. The cell table says for each cell its centroid, how far its
farthest and its nearest point lie from it, and how many there are.

A search first compares the points of the cells nearest to each query that
hold k points together. Its k-th best score there bounds the rest: by the
triangle inequality no point of a cell is nearer to the query than the query's
distance to the centroid less the cell's radius, nor than its nearest point's
distance to the centroid less the query's. Only cells that may still hold a hit
are read after that. The hits are those of comparing all points; how many cells
are spared hangs on the points: clustered ones spare most, vectors without any
structure none. Neighbouring cells come to a task together, and of each query
only the numbers of the cells that it wants: what is moved and stored grows
with the points and the queries, not with pairs of a query and a cell.

A change writes new partitions and a new cell table, and then claims the next
number of the log with one file; readers see the whole change or nothing, and
of two writers that start from the same number the second fails. An upsert
rewrites the cells that it puts points in or takes points from. rebuild() lays
out anew what has grown.
"""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.operators.indexing import payload_error, vector_error
from docquery.operators.vectors import ASKED_BYTES, DIGITS, SPLIT_BYTES, SPLIT_POINTS, SPLIT_QUERIES, TOP_K, best_of_block, latest, matrix, normalised, ranked
from docquery.sources.scratch import claim, exists, written
from docquery.sources.store import Conflict

PAYLOAD = "struct<workspace_id:long,document_id:long,chunk_id:string,chunk_index:int,section:string,document_name:string,source_type:string,page_start:int,page_end:int>"
STORED = f"generation long, workspace_id long, cell int, point_id long, vector array<double>, reach double, payload {PAYLOAD}"
CELLS = "workspace_id long, cell int, generation long, points long, radius double, nearest double, centroid array<double>"
#: Points a cell at least, on average; cells of a workspace at most; points per cell that centroids are fitted on, and rounds.
CELL_POINTS, MOST_CELLS, SAMPLE, ROUNDS = 64, 1024, 32, 4
#: What distances may be off by rounding; cells up to which a list of cells (40 bytes each) is broadcast, which lets Spark prune partitions.
SLACK, BROADCAST_CELLS = 1e-6, 1 << 20
ROWS = ["workspace_id", "cell", "point_id", "vector", "reach", "payload"]
HITS = "query_id long, workspace_id long, cell int, point_id long, score double, tied double"
WANTED = "query_id long, workspace_id long, group long, cells array<int>"


def distances(asked: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean, queries x centroids."""
    squares = (asked**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * asked @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def _fit(sample: pa.Table) -> pa.Table:
    """Centroids of one workspace's sample, whose rows come in the order of their hashes."""
    sample = sample.sort_by("place")
    points = matrix(sample["vector"])
    centroids = points[: sample["cells_of"][0].as_py()].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([distances(points[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(points), 4096)])
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return pa.table({"workspace_id": [sample["workspace_id"][0].as_py()] * len(centroids), "cell": pa.array(range(len(centroids)), pa.int32()), "centroid": list(centroids)}, pa.schema([("workspace_id", pa.int64()), ("cell", pa.int32()), ("centroid", pa.list_(pa.float64()))]))


def _place(points: pa.Table, cells: pa.Table) -> pa.Table:
    """Nearest cell of each point of a part of a workspace, and the distance to its centroid."""
    schema = pa.schema([("workspace_id", pa.int64()), ("point_id", pa.int64()), ("cell", pa.int32()), ("reach", pa.float64())])
    if not len(points) or not len(cells):
        return schema.empty_table()
    vectors, centroids, numbers = matrix(points["vector"]), matrix(cells["centroid"]), cells["cell"].to_numpy()
    near, reach = [], []
    for i in range(0, len(vectors), 4096):
        far = distances(vectors[i : i + 4096], centroids)
        near.append(far.argmin(axis=1))
        # the distance anew, without the cancellation of the product
        reach.append(np.sqrt(((vectors[i : i + 4096] - centroids[near[-1]]) ** 2).sum(axis=1)))
    return pa.table([points["workspace_id"], points["point_id"], pa.array(numbers[np.concatenate(near)]), pa.array(np.concatenate(reach))], schema=schema)


def _cells_to_read(asked: pa.Table, cells: pa.Table, k: int, first: bool) -> pa.Table:
    """(query, group, its cells) of the nearest cells that hold k points, or of those that may hold points within each query's bound; of a part of a workspace's queries."""
    schema = pa.schema([("query_id", pa.int64()), ("workspace_id", pa.int64()), ("group", pa.int64()), ("cells", pa.list_(pa.int32()))])
    if not len(asked) or not len(cells):
        return schema.empty_table()
    cells = cells.sort_by([("group", "ascending"), ("cell", "ascending")])
    numbers, groups, counts, radius, nearest = (cells[c].to_numpy() for c in ("cell", "group", "points", "radius", "nearest"))
    centroids, queries, ids = matrix(cells["centroid"]), matrix(asked["vector"]), asked["query_id"].to_numpy()
    bounds = np.zeros(len(ids)) if first else asked["bound"].to_numpy()
    out = []
    for i in range(0, len(ids), 1024):
        far = distances(queries[i : i + 1024], centroids)
        if first:
            order = np.argsort(far, axis=1, kind="stable")
            taken = np.zeros(far.shape, bool)
            np.put_along_axis(taken, order, np.cumsum(counts[order], axis=1) - counts[order] < k, axis=1)
        else:
            taken = np.maximum(far - radius, nearest - far) <= bounds[i : i + 1024, None] + SLACK
        q, c = np.nonzero(taken)
        # runs of one query and group are a row each
        begins = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (groups[c[1:]] != groups[c[:-1]])]) if len(q) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(q)], pa.int32()), pa.array(numbers[c], pa.int32()))
        out.append(pa.table([pa.array(ids[i + q[begins]]), pa.array([asked["workspace_id"][0].as_py()] * len(begins), pa.int64()), pa.array(groups[c[begins]]), lists], schema=schema))
    return pa.concat_tables(out)


def _group_hits(points: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of each query among the points of its cells, of a part of a group of cells."""
    schema = pa.schema([("query_id", pa.int64()), ("workspace_id", pa.int64()), ("cell", pa.int32()), ("point_id", pa.int64()), ("score", pa.float64()), ("tied", pa.float64())])
    if not len(points) or not len(asked):
        return schema.empty_table()
    points = points.sort_by("cell")
    cell, ids = points["cell"].to_numpy(), points["point_id"].to_numpy()
    held, starts = np.unique(cell, return_index=True)
    lists = asked["cells"].combine_chunks()
    own, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy())
    at = np.minimum(np.searchsorted(held, own), len(held) - 1)
    there = held[at] == own  # a part of a group need not hold points of each cell
    wanted = np.zeros((len(asked), len(held)), bool)
    wanted[of[there], at[there]] = True
    query, place, score, tied = best_of_block(matrix(asked["vector"]), ids, matrix(points["vector"]), k, asked["least"].to_numpy(), np.r_[starts, len(cell)], wanted)
    return pa.table([pa.array(asked["query_id"].to_numpy()[query]), pa.array([asked["workspace_id"][0].as_py()] * len(query), pa.int64()), pa.array(cell[place]), pa.array(ids[place]), pa.array(score), pa.array(tied)], schema=schema)


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / size).cast("int"), F.lit(1))


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _dealt(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def _apart(rows: DataFrame) -> DataFrame:
    """rows with columns of their own, so that both sides of a cogroup can come from one table."""
    return rows.select([F.col(c).alias(c) for c in rows.columns])


class VectorRepository:
    """Points (point_id, vector, payload) of one collection below `root`, by cosine; the payload names the workspace."""

    def __init__(self, spark: SparkSession, root: str, dimension: int, cell_points: int = CELL_POINTS, most_cells: int = MOST_CELLS):
        if dimension <= 0:
            raise ValueError("dimension must be greater than zero")
        self.spark, self.root, self.dimension, self.cell_points, self.most_cells = spark, root.rstrip("/"), dimension, cell_points, most_cells

    def ensure(self) -> None:
        """Create the collection where it is not there; one of another dimension is an error."""
        claim(self.spark, f"{self.root}/log/{0:012d}.json", json.dumps({"n": 0, "dimension": self.dimension, "cells": None}))
        held = self._last()[2]
        if held != self.dimension:
            raise ValueError(f"collection has dimension {held}, not {self.dimension}")

    def _last(self) -> tuple[int, str | None, int]:
        """Number, cell table and dimension of the last change."""
        if not exists(self.spark, f"{self.root}/log"):
            raise ValueError("collection does not exist")
        row = self.spark.read.schema("n long, cells string, dimension int").json(f"{self.root}/log/*.json").orderBy(F.desc("n")).first()
        return row.n, row.cells, row.dimension

    def cells(self) -> DataFrame:
        """workspace_id, cell, generation, points, radius, nearest, centroid of the cells that hold points."""
        return self._cells(self._last()[1])

    def _cells(self, table: str | None) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.root}/{table}") if table else self.spark.createDataFrame([], CELLS)

    def _stored(self, cells: DataFrame, columns: list[str]) -> DataFrame:
        """Stored points of the given cells (workspace_id, cell, generation); partitions of others are not read."""
        keys = ["generation", "workspace_id", "cell"]
        if not exists(self.spark, f"{self.root}/points"):
            return self.spark.createDataFrame([], STORED).select(*keys, *columns)
        wanted = cells.select(*keys).where("generation > 0").distinct()
        if wanted.count() <= BROADCAST_CELLS:
            wanted = F.broadcast(wanted)
        return self.spark.read.schema(STORED).parquet(f"{self.root}/points").select(*keys, *columns).join(wanted, keys)

    def read(self) -> DataFrame:
        """point_id, vector, payload of all points."""
        return self._stored(self.cells(), ["point_id", "vector", "payload"]).select("point_id", "vector", "payload")

    def _checked(self, points: DataFrame, order: str | None) -> DataFrame:
        """point_id, workspace_id, vector of unit length, payload; fails on the first thing wrong."""
        wrong = F.coalesce(F.when(F.col("payload").isNotNull() & (F.col("payload.workspace_id") <= 0), "workspace_id must be greater than zero"), payload_error(), vector_error("vector", self.dimension), F.when(F.forall("vector", lambda x: x == 0), "embedding must not be zero"))
        rows = latest(points.select(*dict.fromkeys(["point_id", "vector", "payload", *([order] if order else [])])), "point_id", order)
        rows = written(rows.select("point_id", F.col("payload.workspace_id").alias("workspace_id"), normalised(F.col("vector")).alias("vector"), "payload", wrong.alias("wrong")), "upsert")
        bad = rows.where("wrong is not null").agg(F.min("wrong")).first()[0]
        if bad:
            raise ValueError(bad)
        return rows.drop("wrong")

    def upsert(self, points: DataFrame, order: str | None = None) -> None:
        """Points replace those with equal ids, the last by `order` of those that share one (see latest); also those of another workspace. Without points nothing happens."""
        base, table, _ = self._last()
        rows = self._checked(points, order)
        if rows.isEmpty():
            return
        old = self._cells(table)
        placed, centroids = self._placed(rows, old)
        lost = self._stored(old, ["point_id"]).join(rows.select("point_id"), "point_id", "left_semi").select("workspace_id", "cell")
        touched = written(placed.select("workspace_id", "cell").union(lost).distinct(), "touched")
        kept = self._stored(old.join(touched, ["workspace_id", "cell"], "left_semi"), ["point_id", "vector", "reach", "payload"]).drop("generation").join(rows.select("point_id"), "point_id", "left_anti")
        self._commit(base, kept.select(ROWS).unionByName(placed), centroids, old.join(touched, ["workspace_id", "cell"], "left_anti"))

    def rebuild(self) -> None:
        """Lay out all points anew, with centroids for as many as there are now."""
        base, table, _ = self._last()
        rows = self._stored(self._cells(table), ["point_id", "vector", "payload"]).select("point_id", "workspace_id", "vector", "payload")
        self._commit(base, *self._placed(written(rows, "rebuild"), self.spark.createDataFrame([], CELLS)), None)

    def _placed(self, rows: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows with cell and reach, and the cells' centroids: those there are, and, for workspaces that have none, new ones."""
        sizes = rows.groupBy("workspace_id").agg(F.count("*").alias("n"))
        fresh = rows.join(old.select("workspace_id").distinct(), "workspace_id", "left_anti").join(sizes, "workspace_id")
        cells_of = F.least(F.lit(self.most_cells), F.ceil(F.col("n") / self.cell_points)).cast("int")
        fresh = fresh.withColumn("place", F.xxhash64("point_id", F.lit(17))).withColumn("cells_of", cells_of)
        # SAMPLE points per cell, about, and 64: those whose hashes are in as large a share of all hashes
        share = F.least(F.lit(1.0), (SAMPLE * F.col("cells_of") + 64) / F.col("n"))
        sample = fresh.where(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30)).select("workspace_id", "vector", "cells_of", "place")
        made = sample.groupBy("workspace_id").applyInArrow(_fit, "workspace_id long, cell int, centroid array<double>")
        centroids = written(old.select("workspace_id", "cell", "centroid").unionByName(made), "centroids")
        parts = sizes.select("workspace_id", _blocks(F.col("n"), SPLIT_POINTS).alias("parts"))
        left = rows.join(parts, "workspace_id").select("workspace_id", _dealt("point_id", "parts").alias("part"), "point_id", "vector")
        right = centroids.join(parts, "workspace_id").select("workspace_id", _every("parts").alias("part"), "cell", "centroid")
        keys = ["workspace_id", "part"]
        near = left.groupBy(*keys).cogroup(_apart(right).groupBy(*keys)).applyInArrow(_place, "workspace_id long, point_id long, cell int, reach double")
        return written(rows.join(near, ["workspace_id", "point_id"]).select(ROWS), "placed"), centroids

    def _commit(self, base: int, rows: DataFrame, centroids: DataFrame, untouched: DataFrame | None) -> None:
        mark = uuid.uuid4()  # of a writer that loses, no log entry names the files
        generation, n = mark.int >> 68, base + 1
        rows.repartition("workspace_id", "cell").sortWithinPartitions("workspace_id", "cell", "reach").write.partitionBy("workspace_id", "cell").parquet(f"{self.root}/points/generation={generation}")
        held = self.spark.read.schema(STORED).parquet(f"{self.root}/points").where(F.col("generation") == generation)
        facts = held.groupBy("workspace_id", "cell").agg(F.lit(generation).cast("long").alias("generation"), F.count("*").alias("points"), F.max("reach").alias("radius"), F.min("reach").alias("nearest"))
        cells = facts.join(centroids, ["workspace_id", "cell"]).select([c.split()[0] for c in CELLS.split(", ")])
        (cells if untouched is None else cells.unionByName(untouched)).write.parquet(f"{self.root}/cells/{mark.hex}")
        if not claim(self.spark, f"{self.root}/log/{n:012d}.json", json.dumps({"n": n, "dimension": self.dimension, "cells": f"cells/{mark.hex}"})):
            raise Conflict(f"change {n} is taken")

    def _grouped(self, cells: DataFrame) -> DataFrame:
        """cells with their group, neighbours by number that hold the points of about one task, and the parts that a group is dealt into where a cell holds more."""
        size = max(1, SPLIT_BYTES // (8 * self.dimension))
        before = F.sum("points").over(Window.partitionBy("workspace_id").orderBy("cell")) - F.col("points")
        grouped = cells.withColumn("group", F.floor(before / size))
        return grouped.withColumn("parts", _blocks(F.sum("points").over(Window.partitionBy("workspace_id", "group")), 2 * size))

    def _hits(self, asked: DataFrame, wanted: DataFrame, cells: DataFrame, k: int) -> DataFrame:
        """The k best of each query (query_id, vector, least) in each group of cells; wanted (query_id, workspace_id, group, cells), cells as _grouped() gives them."""
        both = ["workspace_id", "group"]
        load = wanted.groupBy(*both).agg(_blocks(F.count("*"), max(SPLIT_QUERIES, ASKED_BYTES // (8 * self.dimension))).alias("asked_parts"))
        read = wanted.select("workspace_id", F.explode("cells").alias("cell")).distinct()
        sizes = written(cells.join(read, ["workspace_id", "cell"], "left_semi").join(load, both).select("workspace_id", "cell", "generation", "group", "parts", "asked_parts"), "cells-read")
        keys = [*both, "part", "asked_part"]
        left = self._stored(sizes, ["point_id", "vector"]).join(sizes.drop("generation"), ["workspace_id", "cell"]).select(*both, _dealt("point_id", "parts").alias("part"), _every("asked_parts").alias("asked_part"), "cell", "point_id", "vector")
        asked_of = wanted.join(asked.select("query_id", "vector", "least"), "query_id").join(sizes.select(*both, "parts", "asked_parts").distinct(), both)
        right = asked_of.select(*both, _every("parts").alias("part"), _dealt("query_id", "asked_parts").alias("asked_part"), "query_id", "vector", "least", "cells")
        return left.groupBy(*keys).cogroup(_apart(right).groupBy(*keys)).applyInArrow(functools.partial(_group_hits, k=k), HITS)

    def _wanted(self, asked: DataFrame, cells: DataFrame, k: int, first: bool) -> DataFrame:
        """query_id, workspace_id, group and the numbers of the cells there that a query has to be compared with."""
        parts = asked.groupBy("workspace_id").agg(_blocks(F.count("*"), SPLIT_QUERIES).alias("parts"))
        left = asked.join(parts, "workspace_id").withColumn("part", _dealt("query_id", "parts"))
        right = cells.drop("parts").join(parts, "workspace_id").withColumn("part", _every("parts"))
        keys = ["workspace_id", "part"]
        found = left.groupBy(*keys).cogroup(_apart(right).groupBy(*keys)).applyInArrow(functools.partial(_cells_to_read, k=k, first=first), WANTED)
        return written(found, "cells-to-read")

    def search(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """query_id, workspace_id, rank, score, point_id, payload, error_message: each query's k best points of its workspace.

        queries: query_id (without repeats), workspace_id, vector. Ties as in
        top_k(). Queries without id, of no workspace or with an unusable vector
        have no hits.
        """
        return self.explained(queries, k)[0]

    def explained(self, queries: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
        """What search() gives, and the (query_id, workspace_id, cell) whose points were compared."""
        if k <= 0:
            raise ValueError("limit must be greater than zero")
        usable = F.col("query_id").isNotNull() & (F.col("workspace_id") > 0) & vector_error("vector", self.dimension).isNull()
        asked = written(queries.where(usable).select("query_id", "workspace_id", normalised(F.col("vector")).alias("vector")).where("vector is not null"), "asked")
        cells, none = self._grouped(self.cells()), F.lit(float("-inf"))
        first = self._wanted(asked, cells, k, True)
        near = ranked(self._hits(asked.withColumn("least", none), first, cells, k), k, "tied").where(F.col("rank") == k)
        last = near.select("query_id", (F.col("tied") - 2 * 10.0**-DIGITS).alias("least"), (F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) + 10.0 ** (-DIGITS / 2)).alias("bound"))
        bounded = written(asked.join(last, "query_id", "left").withColumns({"least": F.coalesce("least", none), "bound": F.coalesce("bound", F.lit(float("inf")))}), "bounded")
        rest = self._wanted(bounded, cells, k, False)
        best = written(ranked(self._hits(bounded, rest, cells, k), k), "hits")
        held = self._stored(best.join(cells, ["workspace_id", "cell"]), ["point_id", "payload"]).drop("generation")
        hits = best.join(held, ["workspace_id", "cell", "point_id"]).withColumn("error_message", payload_error())
        return hits.select("query_id", "workspace_id", "rank", "score", "point_id", "payload", "error_message"), first.unionByName(rest).select("query_id", "workspace_id", F.explode("cells").alias("cell")).distinct()

"""Shards of near-equal bytes by a k-d tree over metadata, in DataFrame operations.

The points of the tree are groups of equal texts, weighed by the bytes of all
their rows and placed by the metadata of their row with the smallest doc_id,
so that equal texts share a shard. Groups over 1/LARGE of a shard, of which
there are LARGE times the shards at most, are placed first, the largest first
into the shard with the most room left; a group over a whole shard is dealt
out by id, in parts of half a shard at most.

A node that stands for n leaves is split at the weighted quantile that leaves
each side what room its leaves have left, along the dimension in which its
rows spread widest relative to all rows. Quantiles are exact to a tie: 16 bits
of the chosen dimension, then 32 of the text's hash are narrowed down by
histograms of at most 65 536 sums per node. The driver sees one row per node
and pass; every level is written, so that no plan grows with the depth.

Null text has no bytes; null metadata has a code of its own. Repeated rows are
rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.storage import written

#: Bytes of a row besides its text; rows that one task numbers; leaves whose splits may be broadcast (under 100 bytes each).
ROW_BYTES, NUMBERED, BROADCAST_LEAVES = 16, 50_000, 1 << 18
#: Digits of 16 bits that a cut has at most; share of a leaf that a tie may be off; part of a shard beyond which a group is placed by itself.
DIGITS, TOLERANCE, LARGE = 3, 0.002, 32


def category_code(name: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("\0")), "UTF-8")), F.lit(65536))


def size_code(size: Column) -> Column:
    return F.least(F.lit(65535), F.floor(F.log2(size + 1) * 1024))


def _rows_of(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows) + f" AS t({columns})")


def _spread(r: Row, dimensions: Sequence[str]) -> list[int]:
    return [r[f"max_{d}"] - r[f"min_{d}"] for d in dimensions]


def kd_shards(points: DataFrame, dimensions: Sequence[str], room: Sequence[float]) -> DataFrame:
    """Adds shard (0 to len(room) - 1) to points with size, 16-bit codes `dimensions` and 16-bit digits d1, d2; shard i gets bytes in proportion to room[i]."""
    spark, leaves = points.sparkSession, len(room)
    upto = [0.0, *accumulate(max(x, 1e-9) for x in room)]
    small = lambda df: F.broadcast(df) if leaves <= BROADCAST_LEAVES else df
    digit = F.array(F.element_at(F.array(*dimensions), F.col("dim").cast("int") + 1), *[f"d{i}" for i in range(1, DIGITS)])
    extents = [f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]
    placed, width, open_ = points.withColumn("lo", F.lit(0).cast("long")), None, {0: leaves}
    while any(n > 1 for n in open_.values()):
        stats = {r.lo: r for r in placed.groupBy("lo").agg(F.sum("size").alias("bytes"), *extents).collect()}
        width = width or ([max(1, x) for x in _spread(stats[0], dimensions)] if stats else [1])
        nodes = {}
        for lo, n in open_.items():
            if n > 1 and lo in stats:
                r, share = stats[lo], (upto[lo + n // 2] - upto[lo]) / (upto[lo + n] - upto[lo])
                spread = _spread(r, dimensions)
                nodes[lo] = {"n": n, "goal": int(r.bytes * share), "bytes": r.bytes, "cut": 0, "before": 0, "to": 0, "dim": max(range(len(dimensions)), key=lambda i, s=spread, w=width: s[i] / w[i])}
        if not nodes:
            break
        for depth in range(DIGITS):
            asked = _rows_of(spark, [(lo, x["dim"], x["cut"], x["goal"], x["before"]) for lo, x in nodes.items()], "lo, dim, cut, goal, before")
            keyed = placed.join(small(asked), "lo").withColumn("digit", digit)
            prefix = sum((F.col("digit")[i] * F.lit(65536 ** (depth - 1 - i)) for i in range(depth)), F.lit(0))
            sums = keyed.where(prefix == F.col("cut")).groupBy("lo", "goal", "before", F.col("digit")[depth].alias("at")).agg(F.sum("size").alias("here"))
            along = Window.partitionBy("lo").orderBy("at")
            crossing = sums.withColumn("to", F.col("before") + F.sum("here").over(along)).where("`to` >= goal and `to` - here <= goal").withColumn("first", F.row_number().over(along)).where("first = 1")
            worst = 0.0
            for r in crossing.collect():
                x = nodes[r.lo]
                x["cut"], x["before"], x["to"] = x["cut"] * 65536 + r["at"], r["to"] - r.here, r["to"]
                worst = max(worst, r.here * x["n"] / max(1, x["bytes"]))
            if worst <= TOLERANCE:
                break
        for x in nodes.values():
            x["cut"] += x["to"] - x["goal"] <= x["goal"] - x["before"]  # the tied points go to the nearer side
        cuts = _rows_of(spark, [(lo, x["dim"], x["cut"], x["n"] // 2) for lo, x in nodes.items()], "lo, dim, cut, step")
        value = sum((F.col("digit")[i] * F.lit(65536 ** (depth - i)) for i in range(depth + 1)), F.lit(0))
        placed = placed.join(small(cuts), "lo", "left").withColumn("digit", digit).withColumn("lo", F.col("lo") + F.when(value >= F.col("cut"), F.col("step")).otherwise(0))
        placed = written(placed.drop("dim", "cut", "step", "digit"), "shard-level")
        open_ = {at: n for lo, n in open_.items() for at, n in ([(lo, n // 2), (lo + n // 2, n - n // 2)] if n > 1 else [(lo, n)])}
    return placed.withColumn("shard", F.col("lo").cast("int")).drop("lo")


def pack_large(groups: list[tuple], shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """(key, part, shard) of the groups (key, parts with their bytes), the largest parts first into the emptiest shard, and the room that shards have left."""
    heap, out = [(0.0, i) for i in range(shards)], []
    for size, key, part in sorted(((size, key, part) for key, part, size in groups), reverse=True):
        held, i = heappop(heap)
        out.append((key, part, i))
        heappush(heap, (held + size, i))
    room = [0.0] * shards
    for held, i in heap:
        room[i] = target - held
    return out, room


def slots(rows: DataFrame, shards: int, order: Sequence[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without a task that holds a shard."""
    parts = max(1, rows.count() // (shards * NUMBERED))
    cut = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    return cut.join(counts, ["shard", "part"]).withColumn("slot", F.col("from") + number - 1).drop("from", "part")


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for `shards` shards, or for as many as reach target_bytes."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    codes = {"source_code": category_code("source"), "lang_code": category_code("lang"), "size_code": size_code(F.col("size"))}
    narrow = written(rows.withColumns(codes).drop("source", "lang"), "shard-rows")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    keys = ["text_hash", "text_crc32"]
    few = lambda df: F.broadcast(df) if shards * LARGE <= BROADCAST_LEAVES else df
    groups = narrow.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.min(F.struct("doc_id", *codes)).alias("first"))
    groups = written(groups.select(*keys, "bytes", *[f"first.{c}" for c in codes]), "shard-groups")
    # groups over 1/LARGE of a shard: LARGE * shards at most
    large = groups.where(F.col("bytes") * LARGE * shards > total)
    parts = F.when(F.col("bytes") * shards > total, F.ceil(F.col("bytes") * 2 * shards / total)).otherwise(1)
    dealt = narrow.join(few(large.select(*keys, parts.cast("int").alias("parts"))), keys).withColumn("part", F.pmod(F.xxhash64("doc_id", "size", F.lit(11)), F.col("parts")).cast("int"))
    dealt = written(dealt.select("doc_id", "size", *keys, "part"), "shard-large")
    sizes = [((r.text_hash, r.text_crc32), r.part, r.bytes) for r in dealt.groupBy(*keys, "part").agg(F.sum("size").alias("bytes")).collect()]
    chosen, room = pack_large(sizes, shards, total / shards)
    columns = "text_hash, text_crc32, part, shard"
    places = _rows_of(spark, [(*key, part, shard) for key, part, shard in chosen] or [(0, 0, -1, 0)], columns)
    first = dealt.join(few(places), ["text_hash", "text_crc32", "part"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int"))
    rest = groups.where(F.col("bytes") * LARGE * shards <= total).withColumnRenamed("bytes", "size")
    bits = {"d1": F.pmod("text_hash", F.lit(65536)), "d2": F.pmod(F.shiftright("text_hash", 16), F.lit(65536))}
    small = kd_shards(rest.withColumns(bits), list(codes), room).select(*keys, "shard")
    placed = written(first.unionByName(narrow.join(small, keys).select("doc_id", "size", "text_crc32", "shard")), "shards")
    numbered = slots(placed, shards, ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)

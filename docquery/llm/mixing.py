"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Each source has a target of words: its weight's share of the budget, at most
MOST times its size, the excess reshared by weight. Whole epochs of a source
come first; the rest of its target is filled with documents in order of their
exponential keys -ln(u) / quality, up to the running sum of sizes that is
nearest to it. u is a hash of the id, so reruns agree.

Running sums go over ranges first and within a range then. Spark's range
partitioning cuts them at measured quantiles of (source, key, id, size), so no
task sorts a whole source, however keys lie. Null text has no words; documents
without words are taken 0 times. A null source is a source of its own, after
all others. Null ids share one u; repeated rows are drawn by their common key
and are rows of their own, and ranges may cut between them. Documents without
a positive quality have quality 1. Targets are worked out in one task that
gets a row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.storage import written

WEIGHTS, BUDGET_PERCENT, MOST, SEED, RANGE_ROWS = (3, 1, 2), 150, 2, "mix-1", 20_000


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def uniform(key: str, seed: str) -> Column:
    """In (0, 1): 52 bits of the MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """source_key, source_size, target of the sources (source_key, source_size): a water level over capacity per weight."""
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    upto = weighted.withColumns({
        "full": F.coalesce(F.sum(MOST * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.partitionBy()),
    })
    level = (F.col("all") * budget_percent / 100 - F.col("full")) / F.col("open")
    fits = upto.withColumn("level", F.when(level * F.col("weight") <= MOST * F.col("source_size"), level))
    water = F.coalesce(F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return fits.withColumn("water", water).select("source_key", "source_size", F.least(F.col("water") * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def mixed(docs: DataFrame, quality: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, seed: str = SEED, row: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and `row`, if given; quality has doc_id and quality > 0, where known."""
    known = quality.where("quality > 0").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    name = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    own = [] if row is None else ["row"]
    rows = docs.select("doc_id", name.alias("source_key"), word_count("text").alias("size"), *([] if row is None else [row.alias("row")])).join(known, "doc_id", "left")
    rows = rows.withColumn("key", -F.log(uniform("doc_id", seed)) / F.coalesce("quality", F.lit(1.0)))
    rows = written(rows.select("doc_id", "source_key", "size", "key", *own), "mix-rows")
    # ranges of near-equal numbers of rows in the order of the draw; rows that tie in all that counts are dealt out by their place in the table
    order = ["key", "doc_id", "size", *own]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, "source_key", *order, "tie")
    cut = written(cut.withColumn("range", F.spark_partition_id()).drop("tie"), "mix-ranges")
    sums = written(cut.groupBy("source_key", "range").agg(F.sum("size").alias("n")), "mix-sums")
    aims = targets(sums.groupBy("source_key").agg(F.sum("n").alias("source_size")), weights, budget_percent)
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(aims, "source_key")
    within = Window.partitionBy("source_key", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("upto", F.sum("size").over(within)).join(starts, ["source_key", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    before = F.col("start") + F.col("upto") - F.col("size")
    more = F.when(before + F.col("size") / 2 <= rest, 1).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.least(epochs + more, F.lit(MOST))).cast("long").alias("taken"), *own)


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: 2 for good ones, a half for others."""
    return labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("quality"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return mixed(read("documents"), label_quality(read("labels")))

"""Numbers without gaps, given by many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.functions.text import LINE_END
from docquery.sources.scratch import written

#: monotonically_increasing_id() is the partition's number in the bits above these, and the row's place in it.
PLACE_BITS = 33


def _before(counts: Column, *groups: str, order: str) -> Column:
    """Sum of counts in what comes earlier."""
    return F.coalesce(F.sum(counts).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """rows with `name`, start, start + 1 and so on in the order of the columns `order`; rows equal in them come in any order.

    Rows are dealt by ranges of the order, each task sorts its range, and what
    the ranges before it hold is added: one row per range is all that comes
    together in one place. Rows are written once, so that a lost executor
    changes no number.
    """
    if name in rows.columns:
        raise ValueError(f"rows have a column {name}")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place of it", F.monotonically_increasing_id())
    held = written(dealt, "numbered")
    part = F.shiftright("place of it", PLACE_BITS).alias("part of it")
    counts = held.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select("part of it", _before(F.col("n"), order="part of it").alias("before it"))  # one row per partition
    place = F.col("place of it").bitwiseAND((1 << PLACE_BITS) - 1)
    found = held.withColumn("part of it", F.shiftright("place of it", PLACE_BITS)).join(offsets, "part of it")
    return found.withColumn(name, F.col("before it") + place + F.lit(start).cast("long")).drop("part of it", "place of it", "before it")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of all lines of text files, blank ones too; a file of any size is read by as many tasks as it has splits.

    Lines end where Unicode says. The reader cuts at line feeds and carriage
    returns and within splits keeps the order; what is counted is the lines of
    the splits before.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    cut = raw.select("file", "split", F.explode(F.split("value", LINE_END, -1)).alias("value"))
    held = written(cut.withColumn("place", F.monotonically_increasing_id()), "lines")
    counts = held.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    offsets = counts.select("file", "split", "first", _before(F.col("n"), "file", order="split").alias("before"))
    return held.join(offsets, ["file", "split"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")

"""Rows told apart where they share a doc_id: what happens to one text must not happen to another under its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.storage import written


def text_hash() -> Column:
    return F.xxhash64("text")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with `row`: 0 for an id that has one text, a hash of the text for ids that have several.

    Such ids are written first: where they are few, Spark broadcasts them by
    their size and no text moves.
    """
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash()).alias("least"), F.max(text_hash()).alias("most")).where("least <> most")
    several = written(several.select("doc_id", F.lit(True).alias("several texts")), "repeated-ids")
    return docs.join(several, "doc_id", "left").withColumn("row", F.when(F.col("several texts"), text_hash()).otherwise(F.lit(0).cast("long"))).drop("several texts")


def with_own_id(docs: DataFrame, name: str = "own id") -> DataFrame:
    """docs with an id of each (doc_id, text): doc_id where it has one text, else a negative hash; rows without doc_id have one of their text."""
    hashed = -2 - F.shiftrightunsigned(F.xxhash64("doc_id", text_hash()), 2)
    rows = with_row(docs.withColumnRenamed("row", "row of docs")) if "row" in docs.columns else with_row(docs)
    rows = rows.withColumn(name, F.when(F.col("doc_id").isNotNull() & (F.col("row") == 0), F.col("doc_id").cast("long")).otherwise(hashed)).drop("row")
    return rows.withColumnRenamed("row of docs", "row").select(*docs.columns, name)

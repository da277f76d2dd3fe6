"""A training corpus from raw documents: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the
last returns where each document is stored. Texts that share a doc_id have a
verdict each. Rows without doc_id can't be named by one: they pass the filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.decontamination import contamination
from docquery.llm.identity import with_own_id
from docquery.llm.mixing import label_quality, mixed
from docquery.llm.near_dedup import near_duplicates
from docquery.llm.sharding import sharded
from docquery.llm.storage import written
from docquery.llm.toxicity import flagged

#: Bytes of a shard of the corpus: sharding splits until leaves reach them.
SHARD_BYTES = 128 << 20


def _without(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs less the texts that `judge` names by doc_id."""
    own = with_own_id(docs.where("doc_id is not null"))
    gone = judge(own.drop("doc_id").withColumnRenamed("own id", "doc_id")).select(F.col("doc_id").alias("own id")).distinct()
    return own.join(gone, "own id", "left_anti").select(docs.columns).unionByName(docs.where("doc_id is null"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return _without(docs, lambda own: flagged(own, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near duplicates (five words, similarity 0.8), the one with the smallest doc_id stays."""
    gone = near_duplicates(docs, width=5).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    # a row is told by its id and text: another text under the id of a copy stays
    own = [docs["doc_id"] == F.col("gone_id"), F.xxhash64(docs["text"]) == F.col("gone_hash")]
    return docs.join(gone, own, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents tiled with a benchmark item go."""
    return _without(docs, lambda own: contamination(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; equal rows together as often as all of them."""
    own = docs.select(*docs.columns, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix id"), F.xxhash64(*docs.columns).alias("mix row"))
    taken = mixed(docs, label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")), row=F.xxhash64(*docs.columns))
    times = taken.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix id"), F.col("row").alias("mix row")).agg(F.sum(F.when(F.col("taken") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("mix times"), F.count("*").alias("mix rows"))
    times, keys = written(times.where("`mix times` > 0"), "mix-times"), ["mix id", "mix row"]
    once = own.join(times.where("`mix rows` = 1"), keys)
    repeated = own.join(times.where("`mix rows` > 1"), keys).dropDuplicates(keys)
    return once.unionByName(repeated).withColumn("mix copy", F.explode(F.sequence(F.lit(1), F.col("mix times")))).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document and copy."""
    return sharded(docs, target_bytes=SHARD_BYTES)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier is not expressible in SQL; tests/llm/test_pipeline.py holds each stage's verdicts on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

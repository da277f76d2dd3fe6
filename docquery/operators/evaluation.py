"""Retrieval quality: the rank of the expected chunk, Recall@k and MRR@k, and the misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.operators import numbering

#: Columns of a case and of a hit in the report of misses, fixed values.
CASE = ["query", "workspace_id", "expected_document_id", "expected_document_name", "expected_chunk_id", "expected_chunk_index", "expected_section"]
HIT = ["rank", "score", "document_id", "document_name", "chunk_id", "chunk_index", "section"]


def numbered(cases: DataFrame) -> DataFrame:
    """Cases as read_cases() gives them with query_id, from 1 in the order of files and lines; fails on lines that are no case, and where there are none."""
    wrong = cases.where("error_message is not null").orderBy("file", "line").first()
    if wrong:
        raise ValueError(f"{wrong.error_message} on line {wrong.line}")
    if cases.isEmpty():
        raise ValueError("evaluation dataset contains no cases")
    return numbering.numbered(cases.drop("error_message"), ["file", "line"], "query_id").drop("file", "line")


def case_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (query_id, expected_chunk_id, ...) with relevant_rank, the first rank of a hit with that chunk_id, null for a miss."""
    found = hits.select("query_id", F.col("chunk_id").alias("expected_chunk_id"), "rank").groupBy("query_id", "expected_chunk_id").agg(F.min("rank").alias("relevant_rank"))
    return cases.join(found, ["query_id", "expected_chunk_id"], "left")


def metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(
        F.count("*").alias("cases"),
        F.count("relevant_rank").alias("recalled"),
        F.round(F.avg(F.col("relevant_rank").isNotNull().cast("int")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("relevant_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def failures(ranks: DataFrame, hits: DataFrame) -> DataFrame:
    """Misses as the report has them: the case with what was retrieved instead, in rank order."""
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in HIT if c in hits.columns]))).alias("retrieved"))
    known = ["query_id", *[c for c in CASE if c in ranks.columns]]
    return ranks.where("relevant_rank is null").select(known).join(listed, "query_id", "left")

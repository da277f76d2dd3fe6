"""From stored chunks to points of the vector table: guards, embedding, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import strip
from docquery.operators.vectors import EmbeddingProvider

PAYLOAD = ["workspace_id", "document_id", "chunk_id", "chunk_index", "section", "document_name", "source_type", "page_start", "page_end"]
#: Fields of a payload that must be there, a fixed value.
REQUIRED = ["workspace_id", "document_id", "chunk_id", "chunk_index", "document_name", "source_type"]
# Messages.
NO_CHUNKS, NO_WORKSPACE = "document must contain at least one chunk", "document workspace_id must not be empty"
NOT_STORED, BLANK = "all chunks must be persisted before indexing", "chunk text must not be empty"


def vector_error(vector: str, dimension: int) -> Column:
    """What is wrong with an embedding: it is missing, of another length, or has a component that is not a number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.concat(F.lit(f"embedding dimension mismatch: expected {dimension}, got "), F.size(vector).cast("string"))
    return F.when(F.col(vector).isNull(), "embedding count does not match chunk count").when(F.size(vector) != dimension, size).when(odd, "embedding holds a value that is not finite")


def embedded(chunks: DataFrame, embedder: EmbeddingProvider, dimension: int) -> DataFrame:
    """Chunks (id, document_id, chunk_id, chunk_index, text, section, page_start, page_end) with vector instead of text, and what is wrong with them."""
    held = chunks.select("id", "document_id", "chunk_id", "chunk_index", "text", "section", "page_start", "page_end")
    wrong = F.when(F.col("id").isNull(), NOT_STORED).when(strip(F.coalesce("text", F.lit(""))) == "", BLANK)
    rows = embedder.passages(held.withColumn("wrong", wrong), "text").drop("text")
    return rows.withColumn("wrong", F.coalesce("wrong", vector_error("vector", dimension)))


def indexed(rows: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (point_id, vector, payload) of embedded() chunks, and the documents (document_id, message) that can't be indexed.

    documents: document_id, workspace_id, filename, file_type. A document is
    indexed as a whole or, if anything of it is wrong, not at all; chunks of
    other documents are nobody's and are left out. Where both results are used,
    rows should be written first, or they are embedded twice.
    """
    own = documents.select("document_id", "workspace_id", F.col("filename").alias("document_name"), F.col("file_type").alias("source_type"))
    told = rows.withColumn("reason", F.min("wrong").over(Window.partitionBy("document_id")))
    good = told.where("reason is null").join(own.where("workspace_id is not null"), "document_id")
    bad = own.join(rows.groupBy("document_id").agg(F.min("wrong").alias("wrong"), F.count("*").alias("n")), "document_id", "left")
    message = F.when(F.col("workspace_id").isNull(), NO_WORKSPACE).when(F.col("n").isNull(), NO_CHUNKS).otherwise(F.col("wrong"))
    return good.select(F.col("id").alias("point_id"), "vector", F.struct(*PAYLOAD).alias("payload")), bad.select("document_id", message.alias("message")).where("message is not null")


def payload_error() -> Column:
    """What is wrong with a hit that a vector table returned, as columns point_id and payload."""
    lacking = F.array_compact(F.array(*[F.when(F.col(f"payload.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    return (
        F.when(F.col("point_id").isNull(), "point ID must be an integer")
        .when(F.col("payload").isNull(), "search result is missing payload")
        .when(F.size(lacking) > 0, F.concat(F.lit("payload lacks "), F.array_join(lacking, ", ")))
    )


def searchable(points: DataFrame) -> DataFrame:
    """Points as top_k() takes them; the payload names the workspace."""
    return points.select("point_id", F.col("payload.workspace_id").alias("workspace_id"), "vector")


def with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with their point's payload, and error_message where that is no chunk's."""
    held = hits.join(points.select("point_id", "payload"), "point_id", "left")
    return held.withColumn("error_message", payload_error())

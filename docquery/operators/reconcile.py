"""Whether stored documents, chunks and points belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Problems in the order in which they are listed.
NO_DOCUMENT, REPEATED_DOCUMENT, CHUNK_COUNT, REPEATED_CHUNKS = "NO_DOCUMENT", "REPEATED_DOCUMENT", "CHUNK_COUNT", "REPEATED_CHUNKS"
MISSING_POINTS, ORPHAN_POINTS, REPEATED_POINTS, OTHER_POINTS = "MISSING_POINTS", "ORPHAN_POINTS", "REPEATED_POINTS", "OTHER_POINTS"
#: Hashes are summed in parts of this size, which sums of 2**23 rows a document keep within a long.
HASHES = 1 << 40


def _per_document(rows: DataFrame, key: str, id_of: str, chunk_id: str, name: str) -> DataFrame:
    """Rows and ids per document, and a sum of their hashes that hangs on no order; repeated rows count once in it."""
    each = rows.groupBy(F.col(key).alias("document_id"), F.col(id_of).alias("id"), F.col(chunk_id).alias("chunk_id")).agg(F.count("*").alias("times"))
    own = F.pmod(F.xxhash64("id", "chunk_id"), F.lit(HASHES))
    return each.groupBy("document_id").agg(F.sum("times").alias(f"n_{name}"), F.count("*").alias(f"{name}_ids"), F.sum(own).alias(f"{name}_hash"))


def reconciled(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """document_id, n_documents, n_chunks, n_points, problems of every document that any of the three tables knows.

    documents (document_id, chunk_count), chunks (id, document_id, chunk_id),
    points (point_id, payload). Documents that should have points are those
    with chunks; what a store lacks, holds twice, holds without a document or
    holds for another chunk is told per document, in one shuffle per table.
    """
    told = documents.groupBy("document_id").agg(F.count("*").alias("n_documents"), F.max("chunk_count").cast("long").alias("chunk_count"))
    rows = points.select("point_id", F.col("payload.document_id").alias("document_id"), F.col("payload.chunk_id").alias("chunk_id"))
    held = told.join(_per_document(chunks, "document_id", "id", "chunk_id", "chunks"), "document_id", "full").join(_per_document(rows, "document_id", "point_id", "chunk_id", "points"), "document_id", "full")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_documents", "chunk_count", "n_chunks", "chunks_ids", "chunks_hash", "n_points", "points_ids", "points_hash")}
    held = held.withColumns(counts)
    c = F.col
    found: list[tuple[Column, str]] = [
        (c("n_documents") == 0, NO_DOCUMENT),
        (c("n_documents") > 1, REPEATED_DOCUMENT),
        ((c("n_documents") > 0) & (c("chunk_count") != c("chunks_ids")), CHUNK_COUNT),
        (c("n_chunks") > c("chunks_ids"), REPEATED_CHUNKS),
        (c("points_ids") < c("chunks_ids"), MISSING_POINTS),
        (c("points_ids") > c("chunks_ids"), ORPHAN_POINTS),
        (c("n_points") > c("points_ids"), REPEATED_POINTS),
        ((c("points_ids") == c("chunks_ids")) & (c("points_hash") != c("chunks_hash")), OTHER_POINTS),
    ]
    problems = F.array_join(F.array_compact(F.array(*[F.when(wrong, name) for wrong, name in found])), ",")
    return held.select("document_id", "n_documents", "n_chunks", "n_points", problems.alias("problems"))

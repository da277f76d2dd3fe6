"""Ingestion of a batch of files: documents with their state, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.text import stem
from docquery.operators.chunking import FIELDS, MAX_CHARS, identified
from docquery.operators.parsers import Registry, registry
from docquery.operators.routing import with_file_type

# Messages, and limits of names and sections.
NO_CHUNKS, FAILED_PAGES = "Parsing produced no usable chunks.", "Text extraction failed for pages: "
NAME_CHARS, SECTION_CHARS, MESSAGE_CHARS = 255, 500, 2000
#: Columns that parsed() adds; files must not bring their own.
ADDED = {"file_size_bytes", "checksum", "file_type", "error_code", "error_message", "status", "chunks", "chunk_count", "title", "failed_pages"}


def checked(files: DataFrame, workspaces: DataFrame | None = None, parsers: Registry | None = None) -> DataFrame:
    """files with size, checksum, file_type as the parsers claim it, and error_code and error_message where they are rejected: nothing of those is stored."""
    clash = sorted(ADDED & set(files.columns))
    if clash:
        raise ValueError(f"files have columns that are added: {', '.join(clash)}")
    known = parsers or registry()
    routed = with_file_type(files.withColumns({"file_size_bytes": F.octet_length("content"), "checksum": F.sha2("content", 256)}), known.extensions, known.content_types)
    empty = F.coalesce(F.col("file_size_bytes"), F.lit(0)) == 0
    code = F.when(F.col("error_code") == "INVALID_INPUT", F.col("error_code")).when(F.length("filename") > NAME_CHARS, "INVALID_INPUT").when(empty, "EMPTY_DOCUMENT").otherwise(F.col("error_code"))
    message = F.col("error_message")
    if workspaces is not None:
        routed = in_known_workspaces(routed, workspaces)
        lost = F.concat(F.lit("Workspace "), F.coalesce(F.col("workspace_id").cast("string"), F.lit("null")), F.lit(" does not exist."))
        message = F.when(code.isNull() & F.col("workspace_error").isNotNull(), lost).otherwise(message)
        code = F.coalesce(code, "workspace_error")
    return routed.withColumns({"error_code": code, "error_message": message}).drop("workspace_error")


def pending(files: DataFrame) -> DataFrame:
    """Accepted files of checked() as documents that wait for their parsing."""
    return files.where("error_code is null").drop("content", "error_code").withColumns({"status": F.lit("PENDING"), "error_message": F.lit(None).cast("string"), "chunk_count": F.lit(0)})


def parsed(files: DataFrame, pages: DataFrame | None = None, max_chars: int = MAX_CHARS, workspaces: DataFrame | None = None, parsers: Registry | None = None) -> DataFrame:
    """files (document_id, workspace_id, filename, content_type, content) without content, with state and chunks.

    Each file is read by the parser of its type, all types in one job; pages
    (document_id, page, text, failed, title) are those of PDF files where no
    other parsers are given. A row that can't be stored has an error_code and no
    status. A stored one is COMPLETED, PARTIAL (pages failed) or FAILED, with an
    error_message. Ids must not repeat.
    """
    parsers = parsers or registry(pages)
    routed = checked(files, workspaces, parsers)
    rows, facts = parsers.read(routed.where("error_code is null"), max_chars)
    facts = facts.withColumnRenamed("title", "top")
    lists = rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", *FIELDS))), lambda c: F.struct(*[c[x].alias(x) for x in FIELDS])).alias("chunks"))
    read = routed.drop("content").join(facts, "document_id", "left").join(lists, "document_id", "left")
    failure = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, NO_CHUNKS)
        .when(F.exists("chunks", lambda c: F.length(c["section"]) > SECTION_CHARS), f"section is longer than {SECTION_CHARS} characters")
    )
    partial, rejected = F.coalesce(F.size("failed_pages"), F.lit(0)) > 0, F.col("error_code").isNotNull()
    status = F.when(rejected, F.lit(None)).when(failure.isNotNull(), "FAILED").when(partial, "PARTIAL").otherwise("COMPLETED")
    message = F.when(rejected, F.col("error_message")).when(failure.isNotNull(), failure).when(partial, F.concat(F.lit(FAILED_PAGES), F.array_join("failed_pages", ", ")))
    read = read.withColumns({"status": status, "error_message": F.substring(message, 1, MESSAGE_CHARS)})
    read = read.withColumns({"chunks": F.when(F.col("status").isin("COMPLETED", "PARTIAL"), F.col("chunks")), "title": F.coalesce("top", stem(F.col("filename")))})
    return read.drop("problem", "top").withColumn("chunk_count", F.coalesce(F.size("chunks"), F.lit(0)))


def failed(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """documents with those of errors (document_id, message) FAILED; what is stored of them stays."""
    told = errors.groupBy("document_id").agg(F.min("message").alias("reason"))
    rows = documents.join(told, "document_id", "left")
    wrong: Column = F.col("reason").isNotNull()
    return rows.withColumns({"status": F.when(wrong, "FAILED").otherwise(F.col("status")), "error_message": F.when(wrong, F.substring("reason", 1, MESSAGE_CHARS)).otherwise(F.col("error_message"))}).drop("reason")


def in_known_workspaces(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Adds error_code WORKSPACE_NOT_FOUND where the workspace does not exist."""
    known = workspaces.select(F.col("id").alias("workspace_id"), F.lit(True).alias("known")).distinct()
    return files.join(known, "workspace_id", "left").withColumn("workspace_error", F.when(F.col("known").isNull(), "WORKSPACE_NOT_FOUND")).drop("known")


def chunk_rows(documents: DataFrame) -> DataFrame:
    """Chunks of stored documents, a row each."""
    rows = documents.where("chunks is not null").select("document_id", "workspace_id", F.col("filename").alias("document_name"), F.col("file_type").alias("source_type"), F.posexplode("chunks").alias("chunk_index", "c"))
    return identified(rows.select("document_id", "workspace_id", "document_name", "source_type", "chunk_index", "c.*"))

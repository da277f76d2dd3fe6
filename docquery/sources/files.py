"""Uploaded files and PDF pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "document_id long, page int, text string, failed boolean, title string"
# Messages.
UNREADABLE, ENCRYPTED = "Unable to read PDF file.", "Encrypted PDF files are not supported."
BINARY = "path string, modificationTime timestamp, length long, content binary"


#: Files of a micro-batch.
FILES_PER_TRIGGER = 1000


def read_files(spark: SparkSession, path: str, workspace_id: int, streaming: bool = False, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Files below a folder with the name they were given, and file_key, a 256-bit hash of path and content; a stream takes so many at a time."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if streaming else spark.read
    raw = reader.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return raw.select(F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(b"\0"), F.col("content")), 256).alias("file_key"), F.lit(workspace_id).cast("long").alias("workspace_id"), F.url_decode(name).alias("filename"), F.lit("application/octet-stream").alias("content_type"), "content")


def _file_pages(document: int, content: bytes) -> list[tuple]:
    import io

    from pypdf import PdfReader

    rows = []
    try:
        reader = PdfReader(io.BytesIO(content))
        if reader.is_encrypted:
            return [(document, None, ENCRYPTED, True, None)]
        named = getattr(getattr(reader, "metadata", None), "title", None)
        title = (str(named).strip() or None) if named else None
        for number, page in enumerate(reader.pages, 1):
            try:
                text = (page.extract_text() or "").strip()
                text.encode()
                rows += [(document, number, text, False, title)] if text else []
            except Exception:  # a page that can't be read is reported, the others go on
                rows.append((document, number, None, True, title))
    except Exception:  # a file that can't be read is reported, the others go on
        return [(document, None, UNREADABLE, True, None)]
    return rows


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [row for document, content in zip(batch["document_id"], batch["content"], strict=True) for row in _file_pages(document, content)]
        yield pd.DataFrame(rows, columns=["document_id", "page", "text", "failed", "title"]).astype({"page": "Int32"})


def pdf_pages(files: DataFrame) -> DataFrame:
    """Pages of PDF files; needs pypdf on the executors. A file that can't be read is one failed row without page, whose text says why."""
    return files.select("document_id", "content").mapInPandas(_pages, PAGES)

"""File type by extension and content type, with an error code where they fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.text import mime, strip, suffix

# What is recognised, and the messages.
EXTENSIONS = {".md": "markdown", ".markdown": "markdown", ".pdf": "pdf"}
CONTENT_TYPES = {"text/markdown": "markdown", "text/x-markdown": "markdown", "application/pdf": "pdf"}
CONFLICT = "Filename extension and content type identify different file formats."


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, kind in table.items():
        out = F.when(value == key, kind).otherwise(out)
    return out


def with_file_type(files: DataFrame, extensions: dict[str, str] = EXTENSIONS, content_types: dict[str, str] = CONTENT_TYPES) -> DataFrame:
    """Adds file_type, error_code and error_message to rows with filename and content_type; the tables are those of a registry of parsers, or the usual ones."""
    name, declared = F.coalesce("filename", F.lit("")), F.coalesce("content_type", F.lit("application/octet-stream"))
    by_name, by_type = _lookup(suffix(name), extensions), _lookup(mime(declared), content_types)
    code = F.when(strip(name) == "", "INVALID_INPUT").when(by_name != by_type, "TYPE_CONFLICT").when(F.coalesce(by_name, by_type).isNull(), "UNSUPPORTED_TYPE")
    unsupported = F.concat(F.lit("Unsupported file type: filename='"), name, F.lit("', content_type='"), declared, F.lit("'"))
    message = F.when(code == "INVALID_INPUT", "filename must not be empty").when(code == "TYPE_CONFLICT", CONFLICT).when(code == "UNSUPPORTED_TYPE", unsupported)
    return files.withColumns({"error_code": code, "error_message": message, "file_type": F.when(code.isNull(), F.coalesce(by_name, by_type))})

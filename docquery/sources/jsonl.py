"""Golden cases in, failures out, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.text import strip
from docquery.operators.numbering import read_lines

CASE = "query string, workspace_id long, expected_document_id long, expected_document_name string, expected_chunk_id string, expected_chunk_index int, expected_section string"
REQUIRED = ("query", "workspace_id", "expected_document_id", "expected_document_name", "expected_chunk_id", "expected_chunk_index")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with their file and line, and error_message on lines that are not a case; blank lines are skipped."""
    lines = read_lines(spark, path).withColumn("value", strip(F.col("value"))).where("value <> ''")
    found = lines.withColumn("case", F.from_json("value", f"{CASE}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"case.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    error = F.when(F.col("case").isNull() | F.col("case.broken").isNotNull(), "invalid JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    return found.select("file", "line", "case.*", error.alias("error_message")).drop("broken")


def write_failures(failures: DataFrame, path: str) -> None:
    """A line per missed case with its retrieved array."""
    failures.write.mode("overwrite").json(path)

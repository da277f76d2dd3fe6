"""The engine's text, routing, chunking and search functions for SQL: temporary functions that Catalyst inlines, and views of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquery.functions.text import LINE_END, SPACE_MARKS, SPACES, WHITESPACE
from docquery.operators.routing import CONTENT_TYPES, EXTENSIONS


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + "".join(c if c.isalnum() or c in " -_.,:;()[]{}+*?/<>=" else f"\\u{ord(c):04x}" for c in value) + "'"


def _case(subject: str, table: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items()) + " END"


_PAGE = "coalesce(nullif(cast({0} AS STRING), '0'), '')"
#: Name, parameters, type and body; a function may use those before it.
FUNCTIONS = [
    # text
    ("dq_strip", "s STRING", "STRING", f"trim(BOTH {_text(SPACES)} FROM s)"),
    ("dq_collapse", "s STRING", "STRING", f"regexp_replace(trim(BOTH {_text(SPACES)} FROM s), {_text(WHITESPACE + '+')}, ' ')"),
    ("dq_lines", "s STRING", "ARRAY<STRING>", f"IF(element_at(split(s, {_text(LINE_END)}, -1), -1) = '', slice(split(s, {_text(LINE_END)}, -1), 1, size(split(s, {_text(LINE_END)}, -1)) - 1), split(s, {_text(LINE_END)}, -1))"),
    ("dq_words", "s STRING", "ARRAY<STRING>", f"split(trim(BOTH {_text(SPACE_MARKS)} FROM regexp_replace(s, '[ \\n]+', ' ')), ' ')"),
    # names and types of files
    ("dq_basename", "s STRING", "STRING", f"regexp_extract(s, {_text(chr(40) + '[^/]*' + chr(41) + '/*')} || '\\u005cz', 1)"),
    ("dq_suffix", "s STRING", "STRING", r"lower(regexp_extract(dq_basename(s), '(?s)\\A.+(\\.[^.]+)\\z', 1))"),
    ("dq_stem", "s STRING", "STRING", r"IF(dq_suffix(s) <> '', regexp_extract(dq_basename(s), '(?s)\\A(.+)\\.[^.]+\\z', 1), dq_basename(s))"),
    ("dq_mime", "s STRING", "STRING", "lower(dq_strip(substring_index(s, ';', 1)))"),
    ("dq_type_by_name", "s STRING", "STRING", _case("dq_suffix(s)", EXTENSIONS)),
    ("dq_type_by_mime", "s STRING", "STRING", _case("dq_mime(s)", CONTENT_TYPES)),
    (
        "dq_type_error", "filename STRING, declared STRING", "STRING",
        "CASE WHEN dq_strip(coalesce(filename, '')) = '' THEN 'INVALID_INPUT' WHEN dq_type_by_name(filename) <> dq_type_by_mime(declared) THEN 'TYPE_CONFLICT' WHEN coalesce(dq_type_by_name(filename), dq_type_by_mime(declared)) IS NULL THEN 'UNSUPPORTED_TYPE' END",
    ),
    ("dq_file_type", "filename STRING, declared STRING", "STRING", "IF(dq_type_error(filename, declared) IS NULL, coalesce(dq_type_by_name(filename), dq_type_by_mime(declared)), NULL)"),
    # chunks
    (
        "dq_hard_split", "s STRING, size INT", "ARRAY<STRING>",
        f"transform(regexp_extract_all(trim(BOTH {_text(SPACES)} FROM s), '(?s)(.{{1,' || size || '}}\\\\z|.{{1,' || size || '}}(?= )|.{{1,' || size || '}})' || {_text(WHITESPACE + '*')}, 1), x -> trim(BOTH {_text(SPACES)} FROM x))",
    ),
    ("dq_identity", "section STRING, page_start INT, page_end INT, body STRING", "STRING", f"concat_ws('\\n', coalesce(section, ''), {_PAGE.format('page_start')}, {_PAGE.format('page_end')}, dq_collapse(body))"),
    ("dq_chunk_id", "identity STRING, occurrence BIGINT", "STRING", "sha2(concat(identity, '\\noccurrence:', occurrence), 256)"),
    # context
    ("dq_page_label", "first INT, last INT", "STRING", "CASE WHEN first IS NULL AND last IS NULL THEN 'N/A' WHEN first IS NULL THEN cast(last AS STRING) WHEN last IS NULL OR first = last THEN cast(first AS STRING) ELSE concat(first, '-', last) END"),
    (
        "dq_source_block", "source_id STRING, document_name STRING, page STRING, section STRING, chunk_id STRING, body STRING", "STRING",
        "concat('[', source_id, ']\\ndocument: ', document_name, '\\npage: ', page, '\\nsection: ', IF(coalesce(section, '') = '', 'N/A', section), '\\nchunk_id: ', chunk_id, '\\ncontent:\\n', body)",
    ),
    # vectors
    ("dq_bucket", "word STRING, dimension INT", "INT", "cast(cast(conv(substring(md5(word), 1, 7), 16, 10) AS BIGINT) % dimension AS INT)"),
    ("dq_dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("dq_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "dq_dot(a, b) / nullif(sqrt(dq_dot(a, a)) * sqrt(dq_dot(b, b)), 0D)"),
]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; gives their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]


def views(tables: dict[str, DataFrame], prefix: str = "dq_") -> list[str]:
    """Temporary views of tables under their names with the prefix."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tables]

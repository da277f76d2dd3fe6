"""Parsers by file type: what names and content types they answer to, and how files of theirs become chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import split_lines, strip, utf8
from docquery.operators.chunking import FIELDS, PREFIX_TOO_LONG, markdown_chunks, page_chunks, prefix_too_long
from docquery.operators.markdown import elements
from docquery.operators.routing import CONTENT_TYPES, EXTENSIONS

# Fixed value: a message.
BAD_UTF8 = "Markdown file must be valid UTF-8."
BAD_TEXT = "Text file must be valid UTF-8."
#: What a parser says of a document: what is wrong with all of it, the pages that failed, and its title.
FACTS = ["document_id", "problem", "failed_pages", "title"]

#: (files, max_chars) to chunks (document_id, chunk_index and FIELDS) and FACTS; files have document_id and content.
Parse = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Parser:
    """A file type, the file extensions (with their dot) and content types that mean it, and its transform of all its files at once."""

    file_type: str
    parse: Parse
    extensions: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Registry:
    """Parsers of a job, one per file type; no two may claim an extension or a content type."""

    parsers: tuple[Parser, ...]
    extensions: dict[str, str] = field(init=False)
    content_types: dict[str, str] = field(init=False)

    def __post_init__(self):
        for name, of in (("file type", lambda p: (p.file_type,)), ("extension", lambda p: p.extensions), ("content type", lambda p: p.content_types)):
            claimed = [x.lower() for p in self.parsers for x in of(p)]
            twice = sorted({x for x in claimed if claimed.count(x) > 1})
            if twice:
                raise ValueError(f"{name} has two parsers: {', '.join(twice)}")
        object.__setattr__(self, "extensions", {e.lower(): p.file_type for p in self.parsers for e in p.extensions})
        object.__setattr__(self, "content_types", {c.lower(): p.file_type for p in self.parsers for c in p.content_types})

    def plus(self, parser: Parser) -> Registry:
        """This registry with a parser in place of the one of its file type, or besides."""
        return Registry((*[p for p in self.parsers if p.file_type != parser.file_type], parser))

    def read(self, files: DataFrame, max_chars: int) -> tuple[DataFrame, DataFrame]:
        """Chunks and FACTS of files (document_id, file_type, content) of all types, each read by its parser; other types have none."""
        found = [p.parse(files.where(F.col("file_type") == p.file_type).select("document_id", "content"), max_chars) for p in self.parsers]
        join = lambda parts, names: reduce(DataFrame.unionByName, [x.select(names) for x in parts])
        return join([rows for rows, _ in found], ["document_id", "chunk_index", *FIELDS]), join([facts for _, facts in found], FACTS)


def _facts(rows: DataFrame, problem, title, failed_pages=None) -> DataFrame:
    none = F.array().cast("array<int>") if failed_pages is None else failed_pages
    return rows.select("document_id", problem.cast("string").alias("problem"), none.alias("failed_pages"), title.cast("string").alias("title"))


def parse_markdown(files: DataFrame, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """Sections of UTF-8 Markdown; the title is the first heading of level 1."""
    docs = files.select("document_id", utf8(F.col("content")).alias("body"))
    found = elements(docs.where("body is not null"))
    top = F.col("heading_level") == 1
    told = found.groupBy("document_id").agg(F.bool_or(prefix_too_long(max_chars)).alias("cramped"), F.min_by(F.when(top, F.col("text")), F.when(top, F.col("at"))).alias("top"))
    rows = docs.select("document_id", F.col("body").isNull().alias("bad")).join(told, "document_id", "left")
    return markdown_chunks(found, max_chars), _facts(rows, F.when(F.col("bad"), BAD_UTF8).when(F.col("cramped"), PREFIX_TOO_LONG), F.col("top"))


def text_elements(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain texts (document_id, body), runs of lines that are not blank, as elements() gives those of Markdown."""
    lines = docs.select("document_id", F.posexplode(split_lines(F.col("body"))).alias("i", "raw")).withColumn("blank", strip(F.col("raw")) == "")
    upto = Window.partitionBy("document_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("at", F.sum(F.col("blank").cast("int")).over(upto).cast("int")).where("not blank")
    held = F.sort_array(F.collect_list(F.struct("i", "raw")))
    paragraphs = lines.groupBy("document_id", "at").agg(held.alias("held"))
    text = strip(F.array_join(F.transform("held", lambda x: x["raw"]), "\n"))
    none = F.array().cast("array<string>")
    return paragraphs.select(
        "document_id", "at", text.alias("text"), F.lit("paragraph").alias("element_type"), none.alias("heading_path"), F.lit(None).cast("int").alias("heading_level"),
        (F.get("held", F.lit(0))["i"] + 1).alias("line_start"), (F.element_at("held", -1)["i"] + 1).alias("line_end"), F.lit(0).alias("section_no"),
    )


def parse_text(files: DataFrame, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of UTF-8 text without structure and title."""
    docs = files.select("document_id", utf8(F.col("content")).alias("body"))
    return markdown_chunks(text_elements(docs.where("body is not null")), max_chars), _facts(docs, F.when(F.col("body").isNull(), BAD_TEXT), F.lit(None))


def paged(pages: Callable[[DataFrame], DataFrame]) -> Parse:
    """A parser of files that `pages` turns into pages (document_id, page, text, failed, title); a failed row without page is a file that can't be read, its text the reason."""

    def parse(files: DataFrame, max_chars: int) -> tuple[DataFrame, DataFrame]:
        rows = pages(files)
        good = ~F.coalesce("failed", F.lit(False))
        named = F.max("title") if "title" in rows.columns else F.lit(None)
        told = rows.groupBy("document_id").agg(
            F.sort_array(F.collect_list(F.when(~good, F.col("page").cast("int")))).alias("failed_pages"),
            F.max(F.when(~good & F.col("page").isNull(), F.col("text"))).alias("unreadable"), named.alias("named"),
        )
        return page_chunks(rows.where(good), max_chars), _facts(told, F.col("unreadable"), F.col("named"), F.col("failed_pages"))

    return parse


def _claims(file_type: str) -> dict[str, tuple[str, ...]]:
    of = lambda table: tuple(k for k, v in table.items() if v == file_type)
    return {"extensions": of(EXTENSIONS), "content_types": of(CONTENT_TYPES)}


MARKDOWN = Parser("markdown", parse_markdown, **_claims("markdown"))
#: Not among the usual ones; a job that wants it adds it.
TEXT = Parser("text", parse_text, (".txt", ".text"), ("text/plain",))


def registry(pages: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> Registry:
    """Markdown, and PDF by its pages or by what reads them; without either, PDF files have no text."""
    if pages is None:
        read = lambda files: files.sparkSession.createDataFrame([], "document_id long, page int, text string, failed boolean, title string")
    else:
        read = pages if callable(pages) else lambda _: pages
    return Registry((MARKDOWN, Parser("pdf", paged(read), **_claims("pdf"))))

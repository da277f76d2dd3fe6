"""Markdown structure: headings with their paths, and paragraphs, by windows over a document's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import split_lines, stem, strip

#: Levels of headings, a fixed value.
LEVELS = 6


def elements(docs: DataFrame) -> DataFrame:
    """document_id, at, text, element_type, heading_path, heading_level, line_start, line_end, section_no of Markdown documents (document_id, body).

    A heading nests by position: its depth is one more than its predecessor's,
    or its level if that is less. So depth is the number of headings so far plus
    the least (level - number) among them, and the path at a line holds, for each
    depth down to the current one, the last heading of that depth. section_no
    counts headings. A null body has no elements; document_id must not repeat.
    """
    lines = docs.select("document_id", F.posexplode(split_lines(F.col("body"))).alias("i", "raw"))
    lines = lines.withColumn("x", strip(F.col("raw")))
    marks = F.length(F.regexp_extract("x", r"\A(#{1,6}) ", 1))
    lines = lines.withColumns({"level": F.when(F.startswith("x", F.lit("#")) & (marks > 0), marks), "blank": F.col("x") == ""})
    lines = lines.withColumn("head", F.col("level").isNotNull())
    lines = lines.withColumn("title", F.when(F.col("head"), strip(F.substring(F.col("x"), F.col("level") + 2, F.length("x")))))
    upto = Window.partitionBy("document_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"section_no": F.sum(F.col("head").cast("int")).over(upto), "block": F.sum((F.col("head") | F.col("blank")).cast("int")).over(upto)})
    depth = F.col("section_no") + F.least(F.lit(0), F.min(F.col("level") - F.col("section_no")).over(upto))
    lines = lines.withColumn("depth", F.when(F.col("head"), depth).cast("int"))
    names = [F.last(F.when(F.col("depth") == d, F.col("title")), ignorenulls=True).over(upto) for d in range(1, LEVELS + 1)]
    lines = lines.withColumn("path", F.slice(F.array(*names), F.lit(1), F.coalesce(F.last("depth", ignorenulls=True).over(upto), F.lit(0))))
    # a block opens with a heading or a blank line, and the lines after it up to the next such line are a paragraph
    body = F.when(~F.col("head") & ~F.col("blank"), F.struct("i", "raw"))
    blocks = lines.groupBy("document_id", "block").agg(
        F.max("title").alias("title"), F.max("level").alias("level"), F.min(F.when(F.col("head"), F.col("i"))).alias("at_head"),
        F.sort_array(F.collect_list(body)).alias("held"), F.first("path").alias("path"), F.first("section_no").alias("section_no"),
    )
    null = F.lit(None)
    paragraph = strip(F.array_join(F.transform("held", lambda x: x["raw"]), "\n"))
    element = lambda text, kind, level, first, last: F.struct(text.alias("text"), F.lit(kind).alias("element_type"), level.cast("int").alias("heading_level"), (first + 1).alias("line_start"), (last + 1).alias("line_end"))
    heading = F.when(F.col("title").isNotNull(), element(F.col("title"), "heading", F.col("level"), F.col("at_head"), F.col("at_head")))
    text = F.when(F.size("held") > 0, element(paragraph, "paragraph", null, F.get("held", F.lit(0))["i"], F.element_at("held", -1)["i"]))
    found = blocks.select("document_id", "section_no", F.col("path").alias("heading_path"), F.explode(F.array_compact(F.array(heading, text))).alias("e"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("e.line_start")) - 1
    return found.select("document_id", place.alias("at"), "e.text", "e.element_type", "heading_path", "e.heading_level", "e.line_start", "e.line_end", "section_no")


def titles(docs: DataFrame, found: DataFrame) -> DataFrame:
    """document_id and title of documents (document_id, filename): the first heading of level 1 in elements found, or else the file's stem."""
    tops = found.where("heading_level = 1").groupBy("document_id").agg(F.min_by("text", "at").alias("top"))
    return docs.select("document_id", "filename").join(tops, "document_id", "left").select("document_id", F.coalesce("top", stem(F.col("filename"))).alias("title"))

"""Structure-aware chunks: paragraphs packed within sections, pages merged in order, stable ids.

Texts become pieces (a row each), a fold over the lengths of a document's
pieces numbers the chunks, and pieces of one number are joined. Everything
after the first grouping is dealt by document_id, so it needs no more exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import collapse, hard_split

#: Characters of a chunk, and the least limit that is allowed; ids per document.
MAX_CHARS, LEAST_MAX_CHARS, IDS = 1200, 100, 1_000_000
PREFIX_TOO_LONG = "max_chars is too small for the heading context."
PIECE = ["k", "group", "alone", "prefix", "text", "section", "page", "line_start", "line_end", "part_index", "element_type"]
FIELDS = ["text", "section", "page_start", "page_end", "line_start", "line_end", "part_index", "element_types"]


def _checked(max_chars: int) -> int:
    if max_chars < LEAST_MAX_CHARS:
        raise ValueError(f"max_chars must be at least {LEAST_MAX_CHARS}.")
    return max_chars


def prefix() -> Column:
    """What the chunks of an element start with: its headings."""
    return F.when(F.size("heading_path") > 0, F.concat(F.array_join("heading_path", " > "), F.lit("\n\n"))).otherwise("")


def prefix_too_long(max_chars: int = MAX_CHARS) -> Column:
    """Whether an element is a paragraph whose headings leave it no room."""
    return (F.col("element_type") == "paragraph") & (F.length(prefix()) >= max_chars)


def _packed(pieces: DataFrame, limit: int) -> DataFrame:
    """document_id, chunk_index and FIELDS of pieces (document_id and PIECE): neighbours of one group share a chunk while it fits."""
    held = pieces.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*PIECE))).alias("pieces"))

    def step(state: Column, p: Column) -> Column:
        longer = state["size"] + 2 + F.length(p["text"])
        fits = ~state["closed"] & ~p["alone"] & (state["group"] == p["group"]) & (longer <= limit)
        no = F.when(fits, state["no"]).otherwise(state["no"] + 1)
        return F.struct(
            no.alias("no"), F.when(fits, longer).otherwise(F.length(p["prefix"]) + F.length(p["text"])).alias("size"),
            p["group"].alias("group"), p["alone"].alias("closed"), F.concat(state["out"], F.array(no)).alias("out"),
        )

    start = F.struct(F.lit(-1).alias("no"), F.lit(0).alias("size"), F.lit(-1).cast("long").alias("group"), F.lit(True).alias("closed"), F.array().cast("array<int>").alias("out"))
    numbers = F.aggregate(F.transform("pieces", lambda p: F.struct(p["prefix"].alias("prefix"), p["text"].alias("text"), p["group"].alias("group"), p["alone"].alias("alone"))), start, step, lambda s: s["out"])
    rows = held.withColumn("numbers", numbers).select("document_id", F.explode(F.arrays_zip("numbers", "pieces")).alias("z")).select("document_id", F.col("z.numbers").alias("chunk_index"), "z.pieces.*")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n")
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("k", "element_type"))), lambda x: x["element_type"])
    chunks = rows.groupBy("document_id", "chunk_index").agg(
        F.concat(F.first("prefix"), texts).alias("text"), F.first("section").alias("section"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max("part_index").alias("part_index"), kinds.alias("element_types"),
    )
    return chunks.select("document_id", "chunk_index", *FIELDS)


def markdown_chunks(elements: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of one section each: whole paragraphs as long as they fit, oversized ones split alone; none of a paragraph whose headings leave no room."""
    limit = _checked(max_chars)
    body = elements.where("element_type = 'paragraph'").withColumn("prefix", prefix())
    over = F.length("prefix") + F.length("text") > limit
    parts = F.when(over & (F.length("prefix") < limit), hard_split(F.col("text"), limit - F.length("prefix"))).when(~over, F.array("text"))
    rows = body.withColumn("alone", over).select(*[c for c in body.columns if c != "text"], "alone", F.posexplode(parts).alias("part", "text"))
    section = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > "))
    pieces = rows.select(
        "document_id", F.struct("at", "part").alias("k"), F.col("section_no").cast("long").alias("group"), "alone", "prefix", "text", section.alias("section"), F.lit(None).cast("int").alias("page"),
        "line_start", "line_end", F.when(F.col("alone"), F.col("part")).alias("part_index"), "element_type",
    )
    return _packed(pieces, limit)


def page_chunks(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of pages (document_id, page, text): pages split to size, then neighbours merged while they fit."""
    limit, none = _checked(max_chars), F.lit(None)
    rows = pages.select("document_id", F.col("page").cast("int").alias("page"), F.posexplode(hard_split(F.col("text"), limit)).alias("part", "text"))
    pieces = rows.select(
        "document_id", F.struct("page", "part").alias("k"), F.lit(0).cast("long").alias("group"), F.lit(False).alias("alone"), F.lit("").alias("prefix"), "text", none.cast("string").alias("section"), "page",
        none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), none.cast("int").alias("part_index"), F.lit("page_text").alias("element_type"),
    )
    return _packed(pieces, limit)


def identified(chunks: DataFrame) -> DataFrame:
    """Adds char_count, the content-derived chunk_id and a deterministic id to chunks (document_id, chunk_index, FIELDS)."""
    page = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("0")), F.lit(""))
    identity = F.concat_ws("\n", F.coalesce("section", F.lit("")), page("page_start"), page("page_end"), collapse(F.col("text")))
    # the hash stands for the text while equal chunks of a document are counted
    rows = chunks.withColumns({"identity": identity, "same": F.sha2(identity, 256)})
    occurrence = F.row_number().over(Window.partitionBy("document_id", "same").orderBy("chunk_index")) - 1
    rows = rows.withColumn("chunk_id", F.sha2(F.concat("identity", F.lit("\noccurrence:"), occurrence.cast("string")), 256))
    return rows.drop("identity", "same").withColumns({"char_count": F.length("text"), "id": F.col("document_id") * IDS + F.col("chunk_index") + 1})


def metadata_json(markdown: bool = True) -> Column:
    """The chunk's metadata as JSON text; keys as stored with Markdown or page chunks."""
    if not markdown:
        return F.to_json(F.struct("element_types"))
    path = F.when(F.col("section").isNotNull(), F.split("section", " > ", -1)).otherwise(F.array().cast("array<string>"))
    return F.to_json(F.struct("element_types", path.alias("heading_path"), F.col("section").isNotNull().alias("heading_injected"), "line_start", "line_end", "part_index"))

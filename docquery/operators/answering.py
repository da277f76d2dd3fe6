"""From hits to answers: hydrate, pack a prompt, parse the model's reply, resolve citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import strip

CONTEXT_CHARS = 12_000
# The refusal and the instruction of the prompt.
REFUSAL = "现有文档中没有足够证据回答这个问题。"
INSTRUCTION = "Return an answer based only on the sources. Also identify the exact SOURCE_N identifiers used. If the sources are insufficient, refuse to answer."
INCONSISTENT, UNKNOWN, NO_REPLY = "all retrieved chunks are missing from the chunk table", "LLM cited unknown sources: ", "the model returned an invalid response"
STORED = ["chunk_db_id", "workspace_id", "chunk_id", "document_id", "document_name", "source_type", "chunk_index", "section", "page_start", "page_end", "text"]


def stored_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks joined with their documents; the documents' name, type and workspace count."""
    own = documents.select("document_id", "workspace_id", F.col("filename").alias("document_name"), F.col("file_type").alias("source_type"))
    kept = chunks.select(F.col("id").alias("chunk_db_id"), "document_id", "chunk_id", "chunk_index", "section", "page_start", "page_end", "text")
    return kept.join(own, "document_id").select(STORED)


def hydrated(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits with the stored chunk of their workspace; ranks keep their gaps."""
    ids = hits.select("query_id", "workspace_id", F.col("point_id").alias("chunk_db_id"), F.col("score").alias("retrieval_score"), "rank")
    return ids.join(stored, ["workspace_id", "chunk_db_id"])


def hydrated_by_id(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """The same from a table that is bucketed by chunk_db_id: it is joined on that alone, and the workspace compared after, so that the stored side stays where it is."""
    ids = hits.select("query_id", F.col("workspace_id").alias("asked_in"), F.col("point_id").alias("chunk_db_id"), F.col("score").alias("retrieval_score"), "rank")
    # as a difference, since an equality would become a key of the join that the buckets lack
    return ids.join(stored, "chunk_db_id").where(F.col("asked_in") - F.col("workspace_id") == 0).drop("asked_in")


def missing(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits without a stored chunk."""
    held = stored.select(F.col("chunk_db_id").alias("point_id"), "workspace_id")
    return hits.join(held, ["workspace_id", "point_id"], "left_anti").select("query_id", "point_id", "rank")


def page_label() -> Column:
    first, last = F.col("page_start"), F.col("page_end")
    return F.when(first.isNull() & last.isNull(), "N/A").when(first.isNull(), last.cast("string")).when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws("-", first, last))


def source_block(source_id: Column) -> Column:
    section = F.when(F.coalesce("section", F.lit("")) == "", "N/A").otherwise(F.col("section"))
    parts = (("[", source_id, "]\n"), ("document: ", F.col("document_name"), "\n"), ("page: ", page_label(), "\n"), ("section: ", section, "\n"), ("chunk_id: ", F.col("chunk_id"), "\n"), ("content:\n", F.col("text"), ""))
    return F.concat(*[x for a, c, z in parts for x in (F.lit(a), c, F.lit(z))])


def sources(contexts: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Contexts once per chunk in rank order, with source_id, block and whether they are within the budget."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_db_id").orderBy("rank"))
    order = Window.partitionBy("query_id").orderBy("rank")
    unique = contexts.withColumn("first", first).where("first = 1").drop("first").withColumn("n", F.row_number().over(order))
    blocks = unique.withColumn("source_id", F.concat(F.lit("SOURCE_"), F.col("n").cast("string"))).withColumn("block", source_block(F.col("source_id")))
    upto = F.sum(F.length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 2
    return blocks.withColumn("included", upto <= budget)


def packed(found: DataFrame) -> DataFrame:
    """query_id, prompt_context, source_count, omitted_count, character_count from sources()."""
    inside = F.collect_list(F.when(F.col("included"), F.struct("n", "block")))
    out = found.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(inside), lambda x: x["block"]), "\n\n").alias("prompt_context"),
        F.count_if("included").alias("source_count"),
        (F.count("*") - F.count_if("included")).alias("omitted_count"),
    )
    return out.withColumn("character_count", F.length("prompt_context").cast("long"))


def prompt(question: Column, context: Column) -> Column:
    """The user prompt; null where question or context is blank."""
    asked, given = strip(question), strip(context)
    return F.when((asked != "") & (given != ""), F.concat_ws("\n\n", F.lit("Question:"), asked, F.lit("Sources:"), given, F.lit(INSTRUCTION)))


def parsed_reply(replies: DataFrame) -> DataFrame:
    """Adds text, cited_source_ids, refused and error_message to rows with the JSON text `reply`."""
    value = F.try_parse_json("reply")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    whole = F.schema_of_variant(value).startswith("OBJECT")
    cited = kind("cited_source_ids").isin("ARRAY<STRING>", "ARRAY<VOID>")
    field = lambda name, kind: F.lit(f"answer field '{name}' must be {kind}")
    error = (
        F.when(~F.coalesce(whole, F.lit(False)), "the model returned an invalid response")
        .when(~F.coalesce(kind("text") == "STRING", F.lit(False)), field("text", "a string"))
        .when(~F.coalesce(cited, F.lit(False)), field("cited_source_ids", "an array of strings"))
        .when(~F.coalesce(kind("refused") == "BOOLEAN", F.lit(False)), field("refused", "a boolean"))
    )
    get = lambda name, t: F.when(F.col("error_message").isNull(), F.try_variant_get(value, f"$.{name}", t))
    return replies.withColumn("error_message", error).withColumns({"text": strip(get("text", "string")), "cited_source_ids": get("cited_source_ids", "array<string>"), "refused": get("refused", "boolean")})


def stub_replies(found: DataFrame) -> DataFrame:
    """query_id and a JSON reply that needs no model: the first sentence of the first source, citing the first two."""
    cited = F.transform(F.sort_array(F.collect_list(F.when(F.col("included") & (F.col("n") <= 2), F.struct("n", "source_id")))), lambda x: x["source_id"])
    told = F.max(F.when(F.col("included") & (F.col("n") == 1), F.regexp_extract("text", r"(?s)\A[^.]*", 0)))
    out = found.groupBy("query_id").agg(told.alias("text"), cited.alias("cited_source_ids")).where("text is not null")
    return out.select("query_id", F.to_json(F.struct("text", "cited_source_ids", F.lit(False).alias("refused"))).alias("reply"))


def citations(replies: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, position, source_id and the cited source, in order of first mention; unknown sources are left out."""
    said = replies.where("error_message is null and not refused").select("query_id", F.posexplode(F.array_distinct("cited_source_ids")).alias("position", "source_id"))
    return said.join(found.where("included"), ["query_id", "source_id"])


def answers(questions: DataFrame, hits: DataFrame, found: DataFrame, replies: DataFrame) -> DataFrame:
    """query_id, answer, refused, cited, error_code, error_message of every question; sources without a reply are an invalid one."""
    seen = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    given = found.groupBy("query_id").agg(F.count("*").alias("stored"), F.collect_set(F.when(F.col("included"), F.col("source_id"))).alias("known"))
    said_so = replies.withColumn("replied", F.lit(True))
    rows = questions.select("query_id").join(seen, "query_id", "left").join(given, "query_id", "left").join(said_so, "query_id", "left")
    rows = rows.withColumn("error_message", F.when(F.col("replied").isNull(), NO_REPLY).otherwise(F.col("error_message")))
    wrong = F.filter("cited_source_ids", lambda x: ~F.array_contains("known", x))
    lost = F.col("hits").isNotNull() & F.col("stored").isNull()
    bad = F.col("error_message").isNotNull()
    unknown = (F.size(wrong) > 0) & ~F.col("refused")
    code = F.when(lost, "DATA_INCONSISTENT").when(F.coalesce(F.size("known"), F.lit(0)) <= 0, F.lit(None)).when(bad, "LLM_INVALID").when(unknown, "INVALID_CITATION")
    message = F.when(lost, INCONSISTENT).when(code == "LLM_INVALID", F.col("error_message")).when(code == "INVALID_CITATION", F.concat(F.lit(UNKNOWN), F.array_join(wrong, ", ")))
    refused = F.col("hits").isNull() | (F.coalesce(F.size("known"), F.lit(0)) <= 0) | F.col("refused")
    said = F.when(code.isNotNull(), F.lit(None)).when(refused, REFUSAL).otherwise(F.col("text"))
    cited = F.when(code.isNull() & ~refused, F.array_join(F.array_distinct("cited_source_ids"), ",")).when(code.isNull(), "")
    return rows.select("query_id", said.alias("answer"), F.when(code.isNull(), refused).alias("refused"), cited.alias("cited"), code.alias("error_code"), message.alias("error_message"))


def public(cited: DataFrame) -> DataFrame:
    """Citations as shown to users, without the ids of chunks and documents."""
    return cited.select("query_id", "position", "source_id", "document_name", "source_type", "section", "page_start", "page_end", F.col("text").alias("quote"))

import pytest
from pyspark.sql import functions as F

from docquery.operators import ingest
from docquery.operators.parsers import BAD_TEXT, MARKDOWN, TEXT, Parser, Registry, parse_text, registry
from docquery.operators.routing import with_file_type

FILES = "document_id long, workspace_id long, filename string, content_type string, content binary"


def test_plain_text_is_added_without_touching_ingestion(spark):
    rows = [(1, 1, "a.md", None, b"# T\n\none\n"), (2, 1, "b.txt", "text/plain", "öne\r\ntwo\n\n \nthree".encode()), (3, 1, "c", "TEXT/PLAIN;x", b"\xff"), (4, 1, "d.txt", None, b" \n\n"), (5, 1, "e.txt", "text/markdown", b"x"), (6, 1, "f.pdf", None, b"x"), (7, 1, "g.log", None, b"x")]
    files = spark.createDataFrame(rows, FILES)
    pages = spark.createDataFrame([(6, 1, "page", False)], "document_id long, page int, text string, failed boolean")
    got = {r.document_id: r for r in ingest.parsed(files, parsers=registry(pages).plus(TEXT)).collect()}
    assert {i: (r.file_type, r.status, r.error_code) for i, r in got.items()} == {
        1: ("markdown", "COMPLETED", None), 2: ("text", "COMPLETED", None), 3: ("text", "FAILED", None), 4: ("text", "FAILED", None),
        5: (None, None, "TYPE_CONFLICT"), 6: ("pdf", "COMPLETED", None), 7: (None, None, "UNSUPPORTED_TYPE"),
    }
    assert [(c.text, c.line_start, c.line_end, c.section) for c in got[2].chunks] == [("öne\ntwo\n\nthree", 1, 5, None)]
    assert got[3].error_message == BAD_TEXT and got[4].error_message == ingest.NO_CHUNKS and (got[1].title, got[2].title) == ("T", "b")
    usual = {r.document_id: r.error_code for r in ingest.parsed(files).collect()}
    assert usual[2] == usual[4] == "UNSUPPORTED_TYPE" and usual[1] is None


def test_long_paragraphs_of_text_are_split(spark):
    docs = spark.createDataFrame([(1, ("word " * 100 + "\n\nshort").encode())], "document_id long, content binary")
    chunks, facts = parse_text(docs, 120)
    found = [(r.part_index, len(r.text)) for r in chunks.orderBy("chunk_index").collect()]
    assert [p for p, _ in found] == [0, 1, 2, 3, 4, None] and max(n for _, n in found) <= 120 and facts.first().problem is None


def test_registry_of_ones_own(spark):
    def shout(files, max_chars):
        chunks, facts = parse_text(files.withColumn("content", F.encode(F.upper(F.col("content").cast("string")), "UTF-8")), max_chars)
        return chunks, facts.withColumn("title", F.lit("Loud"))

    own = registry().plus(Parser("loud", shout, (".LOUD",), ("text/x-loud",)))
    assert own.extensions[".loud"] == "loud" and registry().extensions.keys() == {".md", ".markdown", ".pdf"}
    done = ingest.parsed(spark.createDataFrame([(1, 1, "x.loud", None, b"hey")], FILES), parsers=own).first()
    assert (done.title, done.chunks[0].text) == ("Loud", "HEY")
    assert with_file_type(spark.createDataFrame([("y", "Text/X-Loud")], "filename string, content_type string"), own.extensions, own.content_types).first().file_type == "loud"
    replaced = own.plus(Parser("markdown", parse_text, (".md",)))
    assert ".markdown" not in replaced.extensions and len(replaced.parsers) == 3
    for clash in (Parser("other", parse_text, (".MD",)), Parser("other", parse_text, (), ("text/markdown",))):
        with pytest.raises(ValueError, match="two parsers"):
            registry().plus(clash)
    with pytest.raises(ValueError, match="file type"):
        Registry((MARKDOWN, MARKDOWN))

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquery.functions import text
from docquery.operators import answering, evaluation, ingest, parsers
from docquery.operators.chunking import identified, markdown_chunks, page_chunks
from docquery.operators.indexing import BLANK, NO_CHUNKS, NO_WORKSPACE, NOT_STORED, embedded, indexed, searchable, with_payload
from docquery.operators.markdown import elements, titles
from docquery.operators.routing import with_file_type
from docquery.operators.vectors import HashEmbedder, checked_queries, top_k, upserted
from docquery.sources import files
from docquery.sources.files import read_files
from docquery.sources.jsonl import read_cases, write_failures
from docquery.sources.store import Conflict, Store, Table
from docquery.streaming.ingestion import ingest_stream

SPACES = [*map(chr, range(9, 14)), *map(chr, range(0x1C, 0x21)), *map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_whitespace_lines_and_names(spark):
    assert column(spark, [c + "x y" + c for c in SPACES], text.strip) == ["x y"] * 29
    samples = ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\r"]
    assert column(spark, samples, text.split_lines) == [s.splitlines() for s in samples]
    assert column(spark, ["a.MD", ".md", "x.tar.gz", "a.", "dir/b.PDF"], text.suffix) == [".md", "", ".gz", "", ".pdf"]
    assert column(spark, ["a.MD", ".md", "x.tar.gz"], text.stem) == ["a", ".md", "x.tar"]
    assert column(spark, [b"ok", b"\xff"], text.utf8, "binary") == ["ok", None]


def split_model(s, limit):
    rest, out = s.strip(), []
    while len(rest) > limit:
        cut = rest.rfind(" ", 0, limit + 1)
        cut = cut if cut > 0 else limit
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return out + ([rest] if rest else [])


def test_hard_split_matches_a_model(spark):
    rng = random.Random(1)
    samples = ["".join(rng.choice("ab  　\U0001f600") for _ in range(rng.randrange(80))) for _ in range(300)] + ["", "x" * 25]
    assert column(spark, samples, lambda c: text.hard_split(c, 7)) == [split_model(s, 7) for s in samples]


def test_routing(spark):
    rows = [("guide.md", "application/octet-stream"), ("guide.pdf", "text/markdown"), ("guide.docx", "application/msword"), ("x", " Application/PDF; q=1"), (" ", "text/markdown"), ("g.markdown", None)]
    got = with_file_type(spark.createDataFrame(rows, "filename string, content_type string")).select("file_type", "error_code").collect()
    assert [tuple(r) for r in got] == [("markdown", None), (None, "TYPE_CONFLICT"), (None, "UNSUPPORTED_TYPE"), ("pdf", None), (None, "INVALID_INPUT"), ("markdown", None)]


def docs_of(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "document_id long, body string")


def elements_of(spark, body):
    return elements(docs_of(spark, body)).orderBy("at").collect()


def test_markdown_structure(spark):
    body = "# Project\n\nIntro paragraph.\n\n## Parsing\n\nParser keeps source structure.\n"
    found = elements_of(spark, body)
    assert [(e.text, e.element_type, e.heading_path, e.line_start, e.line_end) for e in found][-1] == ("Parser keeps source structure.", "paragraph", ["Project", "Parsing"], 7, 7)
    assert [e.at for e in found] == [0, 1, 2, 3]
    nest = elements_of(spark, "### C\n### D\n### E\n### F\n# A\n### G\n## B")
    assert [" > ".join(e.heading_path) for e in nest] == ["C", "C > D", "C > D > E", "C > D > F", "A", "A > G", "A > B"]
    plain = elements_of(spark, "#x\n#\tx\n####### x\n#\n```\n# c\n```")
    assert [e.element_type for e in plain] == ["paragraph", "heading", "paragraph"]
    files_ = docs_of(spark, body, "text", None).withColumn("filename", F.lit("doc.md"))
    assert [r.title for r in titles(files_, elements(files_)).orderBy("document_id").collect()] == ["Project", "doc", "doc"]


def model_elements(body):
    """The structure by its definition, a line at a time."""
    path, held, out = [], [], []
    for n, raw in enumerate([*body.splitlines(), ""], 1):
        x = raw.strip()
        marks = len(x) - len(x.lstrip("#"))
        head = 0 < marks < 7 and x[marks : marks + 1] == " "
        if (head or not x) and held:
            out.append(("\n".join(t for _, t in held).strip(), "paragraph", list(path), held[0][0], held[-1][0]))
            held = []
        if head:
            path = [*path[: marks - 1], x[marks + 1 :].strip()]
            out.append((path[-1], "heading", list(path), n, n))
        elif x:
            held.append((n, raw))
    return out


def test_elements_match_a_model(spark):
    rng = random.Random(3)
    parts = ["# a", "## b", "### c", "#### d", "###### e", " ## a > b ", "#x", "text", "  more\u3000", "", "\u2003", "x\r", "####### no", "y\x0bz"]
    bodies = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(120)]
    got = {}
    for e in elements(docs_of(spark, *bodies)).orderBy("document_id", "at").collect():
        got.setdefault(e.document_id, []).append((e.text, e.element_type, e.heading_path, e.line_start, e.line_end))
    assert got == {i: found for i, b in enumerate(bodies) if (found := model_elements(b))}


def chunks_of(spark, body, limit=1200):
    return identified(markdown_chunks(elements(docs_of(spark, body)), limit)).orderBy("chunk_index").collect()


def test_chunks_and_ids(spark):
    (one,) = chunks_of(spark, "# Authentication\n\nUse an API key.\n\nRotate keys regularly.\n", 200)
    assert (one.text, one.section, one.element_types) == ("Authentication\n\nUse an API key.\n\nRotate keys regularly.", "Authentication", ["paragraph", "paragraph"])
    assert chunks_of(spark, "# Only\n") == []
    assert chunks_of(spark, "# Authentication\n\nUse an API key.\n")[0].chunk_id == "d082c1e77af5597d068f1c7b4b477c6f68a38d74639309df44d54dab85073202"
    assert chunks_of(spark, "# Other\n\nx\n\n# Stable\n\nStable content.\n")[1].chunk_id == "6a95a2ec889cf0ea86f003b2c7f20c9ec665d82310e7260dd28c441a7649807c"
    twice = chunks_of(spark, "# A\n\nsame\n\n# A\n\nsame\n")
    assert [c.chunk_id[:8] for c in twice] == ["77605761", "9490c534"]
    over = chunks_of(spark, "# S\n\nsmall\n\n" + "y" * 250 + "\n\ntail\n", 120)
    assert [c.part_index for c in over] == [None, 0, 1, 2, None] and max(c.char_count for c in over) <= 120
    with pytest.raises(ValueError, match="at least 100"):
        markdown_chunks(elements(docs_of(spark, "x")), 99)


def test_page_chunks(spark):
    df = spark.createDataFrame([(1, 2, "Page two."), (1, 1, "Page one."), (2, 1, None), (3, 1, " ")], "document_id long, page int, text string")
    (c,) = identified(page_chunks(df, 100)).collect()
    assert (c.text, c.page_start, c.page_end) == ("Page one.\n\nPage two.", 1, 2)
    assert c.chunk_id == "40c05f57c810e9b87d6b975a6921ee19f90939c9d7889bf4a085d3318cdffafa"


def test_ingest_states(spark):
    rows = [
        (1, 1, "a.md", None, b"# Authentication\n\nUse an API key.\n"), (2, 1, "broken.md", None, b"\xff\xfe\xfd"), (3, 1, "empty.md", None, b""), (4, 1, "p.pdf", None, b"x"),
        (5, 1, "q.pdf", None, b"x"), (6, 1, "h.md", None, b"# only\n"), (7, 1, "x.doc", None, b"x"), (8, 1, "n" * 256 + ".md", None, b"x"), (9, 1, "c.md", None, b"# " + b"s" * 1200 + b"\n\nbody"),
    ]
    pages = [(4, 1, "one", False), (4, 2, None, True), (4, 3, "three", False), (5, 1, None, True)]
    done = ingest.parsed(spark.createDataFrame(rows, "document_id long, workspace_id long, filename string, content_type string, content binary"), spark.createDataFrame(pages, "document_id long, page int, text string, failed boolean"))
    got = {r.document_id: (r.status, r.error_code, r.error_message, r.chunk_count) for r in done.collect()}
    assert got[1][:2] == ("COMPLETED", None) and got[1][3] == 1
    assert got[2] == ("FAILED", None, parsers.BAD_UTF8, 0)
    assert got[3][:2] == (None, "EMPTY_DOCUMENT") and got[7][:2] == (None, "UNSUPPORTED_TYPE") and got[8][:2] == (None, "INVALID_INPUT")
    assert got[4] == ("PARTIAL", None, "Text extraction failed for pages: 2", 1)
    assert got[5] == ("FAILED", None, ingest.NO_CHUNKS, 0) and got[6] == ("FAILED", None, ingest.NO_CHUNKS, 0)
    assert got[9] == ("FAILED", None, "max_chars is too small for the heading context.", 0)
    sums = {r.document_id: r.checksum for r in done.collect()}
    assert sums[1] == "2b68a7afc77d7e4f2642a6b13cf4e841ebafdcee7617b9857caefe7a40272edc"
    assert ingest.chunk_rows(done).count() == 2
    with pytest.raises(ValueError, match="status, title"):
        ingest.parsed(done.select("document_id", "workspace_id", "filename", "content_type", F.lit(b"x").alias("content"), "status", "title"))


CHUNK = "id long, document_id long, chunk_id string, chunk_index int, text string, section string, page_start int, page_end int"


class FixedEmbedder(HashEmbedder):
    """Vectors of 8 numbers, but for some texts none, a short or a broken one."""

    def passages(self, df, text):
        good = F.array(*[F.lit(float(i)) for i in range(8)])
        return df.withColumn("vector", F.when(F.col(text) == "none", None).when(F.col(text) == "short", F.slice(good, 1, 2)).when(F.col(text) == "nan", F.transform(good, lambda _: F.lit(float("nan")))).otherwise(good))


def test_indexing_guards_and_payload(spark):
    rows = [(10, 1, "a", 0, "one", "S", 1, 2), (11, 1, "b", 1, "two", None, None, None), (20, 2, "c", 0, "  ", None, None, None), (None, 3, "d", 0, "x", None, None, None), (40, 4, "e", 0, "short", None, None, None)]
    rows += [(50, 5, "f", 0, "nan", None, None, None), (51, 5, "g", 1, "fine", None, None, None), (60, 6, "h", 0, "none", None, None, None), (70, 7, "i", 0, "x", None, None, None), (99, 99, "z", 0, "nobody's", None, None, None)]
    docs = spark.createDataFrame([(i, None if i == 7 else 5, f"d{i}.md", "markdown") for i in range(1, 9)], "document_id long, workspace_id long, filename string, file_type string")
    points, errors = indexed(embedded(spark.createDataFrame(rows, CHUNK), FixedEmbedder(8), 8), docs)
    held = {r.point_id: r.payload.asDict() for r in points.collect()}
    assert held.keys() == {10, 11}
    assert held[10] == {"workspace_id": 5, "document_id": 1, "chunk_id": "a", "chunk_index": 0, "section": "S", "document_name": "d1.md", "source_type": "markdown", "page_start": 1, "page_end": 2}
    told = {r.document_id: r.message for r in errors.collect()}
    assert {i: told[i] for i in (2, 3, 7, 8)} == {2: BLANK, 3: NOT_STORED, 7: NO_WORKSPACE, 8: NO_CHUNKS} and told.keys() == set(range(2, 9))
    assert "expected 8, got 2" in told[4] and "not finite" in told[5] and "count" in told[6]
    hits = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "query_id long, point_id long, rank int")
    assert [(r.payload and r.payload.chunk_id, r.error_message) for r in with_payload(hits, points).orderBy("rank").collect()] == [("a", None), (None, "search result is missing payload")]
    assert searchable(points).columns == ["point_id", "workspace_id", "vector"]


def test_answers_of_every_kind(spark):
    questions = spark.createDataFrame([(i,) for i in range(1, 9)], "query_id long")
    hits = spark.createDataFrame([(i, 1) for i in (1, 3, 4, 5, 6, 7, 8)], "query_id long, point_id long")
    found = spark.createDataFrame([(i, "SOURCE_1", i != 8) for i in (1, 4, 5, 6, 7, 8)], "query_id long, source_id string, included boolean")
    said = [(1, "yes", ["SOURCE_1", "SOURCE_1"], False, None), (4, "no", [], True, None), (5, "x", ["SOURCE_99"], False, None), (6, None, None, None, "broken")]
    replies = spark.createDataFrame(said, "query_id long, text string, cited_source_ids array<string>, refused boolean, error_message string")
    got = {r.query_id: tuple(r)[1:] for r in answering.answers(questions, hits, found, replies).collect()}
    refusal = (answering.REFUSAL, True, "", None, None)
    assert got == {
        1: ("yes", False, "SOURCE_1", None, None), 2: refusal, 3: (None, None, None, "DATA_INCONSISTENT", answering.INCONSISTENT), 4: refusal, 8: refusal,
        5: (None, None, None, "INVALID_CITATION", answering.UNKNOWN + "SOURCE_99"), 6: (None, None, None, "LLM_INVALID", "broken"), 7: (None, None, None, "LLM_INVALID", answering.NO_REPLY),
    }


def test_search_and_upsert(spark):
    pts = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [1.0, 0.0])], "point_id long, workspace_id long, vector array<double>")
    qs = spark.createDataFrame([(9, 1, [1.0, 0.0])], "query_id long, workspace_id long, vector array<double>")
    assert [(r.point_id, r["rank"]) for r in top_k(pts, qs, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(ValueError, match="limit"):
        top_k(pts, qs, 0)
    new = spark.createDataFrame([(3, 1, [9.0, 9.0]), (5, 1, [1.0, 1.0])], pts.schema)
    assert {r.point_id: r.vector[0] for r in upserted(pts, new).collect()} == {1: 1.0, 2: 1.0, 3: 9.0, 4: 1.0, 5: 1.0}
    vec = HashEmbedder(8).queries(spark.createDataFrame([(" FastAPI IOC ",)], "t string"), "t").first().vector
    counts = HashEmbedder(200).passages(spark.createDataFrame([("a a b",)], "t string"), "t").first().vector
    assert sorted(x for x in counts if x)[-1] > 0.7 and len(counts) == 200
    assert abs(sum(x * x for x in vec) - 1) < 1e-12
    texts = ["a a b", "", None, "w " * 5000, " ".join(f"W{i} w{i % 7}" for i in range(3000))]
    for dimension in (1, 16, 768):
        found = HashEmbedder(dimension).passages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
        for t, r in zip(texts, found, strict=True):
            want = [0] * dimension
            for w in f"passage: {(t or '').strip()}".lower().split(" "):
                if w:
                    want[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dimension] += 1
            size = sum(x * x for x in want) ** 0.5
            assert r.vector is None if t is None else all(abs(x - y / size) < 1e-12 for x, y in zip(r.vector, want, strict=True))
    bad = checked_queries(spark.createDataFrame([(1, 1, " "), (2, 0, "x"), (3, 1, "x")], "query_id long, workspace_id long, question string"))
    assert {r.query_id: r.error_code for r in bad.collect()} == {1: "INVALID_INPUT", 2: "INVALID_INPUT", 3: None}


CONTEXT = "query_id long, chunk_db_id long, chunk_id string, document_name string, section string, page_start int, page_end int, text string, rank int"


def test_context_order_budget_and_labels(spark):
    rows = [(1, 20, "c", "d", None, 3, 5, "second", 2), (1, 10, "c", "d", "S", 3, 3, "first", 1), (1, 10, "c", "d", "S", 3, 3, "first", 3), (1, 30, "c", "d", "", None, 2, "z", 4)]
    found = answering.sources(spark.createDataFrame(rows, CONTEXT))
    blocks = {r.source_id: r.block for r in found.collect()}
    assert blocks["SOURCE_1"] == "[SOURCE_1]\ndocument: d\npage: 3\nsection: S\nchunk_id: c\ncontent:\nfirst"
    assert "page: 3-5\nsection: N/A" in blocks["SOURCE_2"] and "page: 2\n" in blocks["SOURCE_3"]
    size = len(blocks["SOURCE_1"])
    small = answering.packed(answering.sources(spark.createDataFrame(rows, CONTEXT), size)).first()
    assert (small.source_count, small.omitted_count, small.character_count) == (1, 2, size)
    none = answering.packed(answering.sources(spark.createDataFrame(rows, CONTEXT), 10)).first()
    assert (none.prompt_context, none.source_count, none.omitted_count) == ("", 0, 3)
    stub = answering.parsed_reply(answering.stub_replies(found)).first()
    assert (stub.text, stub.cited_source_ids, stub.refused) == ("first", ["SOURCE_1", "SOURCE_2"], False)


def test_replies(spark):
    rows = [(1, '{"text": " a ", "cited_source_ids": [], "refused": false}'), (2, "[1]"), (3, "{bad"), (4, '{"text": "a", "cited_source_ids": [1], "refused": false}'), (5, '{"text": "a", "cited_source_ids": [], "refused": "no"}'), (6, None)]
    got = {r.query_id: (r.text, r.error_message) for r in answering.parsed_reply(spark.createDataFrame(rows, "query_id long, reply string")).collect()}
    assert got[1] == ("a", None) and all(got[i][0] is None and got[i][1] for i in range(2, 7))
    assert "cited_source_ids" in got[4][1] and "refused" in got[5][1]


def test_evaluation(spark, tmp_path):
    ranks = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None), (4, "d", 4)], "query_id long, expected_chunk_id string, relevant_rank int")
    m = evaluation.metrics(ranks).first()
    assert (m.cases, m.recalled, m.recall, m.mrr) == (4, 3, 0.75, 0.4375)
    hits = spark.createDataFrame([(3, "x", 0.5, 2), (3, "y", 0.9, 1)], "query_id long, chunk_id string, score double, rank int")
    write_failures(evaluation.failures(ranks, hits), str(tmp_path / "out"))
    assert [x["chunk_id"] for x in spark.read.json(str(tmp_path / "out")).first().retrieved] == ["y", "x"]
    case = {"query": "qé", "workspace_id": 1, "expected_document_id": 1, "expected_document_name": "d", "expected_chunk_id": "c", "expected_chunk_index": 0}
    (tmp_path / "g.jsonl").write_text("\n".join([json.dumps(case), "  ", "{bad", '{"query": "x"}']))
    cases = read_cases(spark, str(tmp_path / "g.jsonl")).orderBy("line")
    got = [(r.line, r.error_message) for r in cases.collect()]
    assert got[:2] == [(1, None), (3, "invalid JSON")] and got[2][1].startswith("missing: workspace_id")
    with pytest.raises(ValueError, match="invalid JSON on line 3"):
        evaluation.numbered(cases)
    with pytest.raises(ValueError, match="no cases"):
        evaluation.numbered(cases.where("line > 9"))


@pytest.mark.parametrize("k", [1, 3])
def test_evaluation_from_a_file_to_its_report(spark, tmp_path, k):
    """Cases from JSON lines, search over indexed chunks, ranks by chunk id, and the report of misses."""
    chunks = spark.createDataFrame([(i, 1 + i % 2, f"c{i}", i, f"word{i} word{i + 1}", None, None, None) for i in range(6)], CHUNK)
    docs = spark.createDataFrame([(1, 7, "a.md", "markdown"), (2, 7, "b.md", "markdown")], "document_id long, workspace_id long, filename string, file_type string")
    embedder = HashEmbedder(32)
    points, _ = indexed(embedded(chunks, embedder, 32), docs)
    lines = [{"query": f"word{i} word{i + 1}", "workspace_id": 7, "expected_document_id": 1 + i % 2, "expected_document_name": "a.md", "expected_chunk_id": c, "expected_chunk_index": i} for i, c in ((0, "c0"), (3, "c3"), (4, "gone"))]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, lines)))
    cases = evaluation.numbered(read_cases(spark, str(tmp_path / "g.jsonl")))
    hits = with_payload(top_k(searchable(points), embedder.queries(cases, "query"), k), points).select("query_id", "rank", "score", "payload.*")
    ranks = evaluation.case_ranks(cases, hits)
    assert {r.query_id: r.relevant_rank for r in ranks.collect()} == {1: 1, 2: 1, 3: None}
    write_failures(evaluation.failures(ranks, hits), str(tmp_path / "out"))
    (row,) = spark.read.json(str(tmp_path / "out")).collect()
    assert (row.expected_chunk_id, row.workspace_id, len(row.retrieved), row.retrieved[0]["rank"]) == ("gone", 7, k, 1) and row.retrieved[0]["document_name"] in ("a.md", "b.md")


DOCUMENTS = "file_key string, document_id long, workspace_id long, filename string, status string, error_message string, created_at timestamp, updated_at timestamp"


def test_streaming_ingestion_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.md").write_text(f"# T{i}\n\nbody {i}\n")
    (tmp_path / "in" / "x.doc").write_text("no")
    store = Store(spark, str(tmp_path / "store"))
    documents, rejected = Table(store, "documents", DOCUMENTS), Table(store, "rejected", "file_key string, workspace_id long, filename string, error_code string, error_message string")
    chunks = Table(store, "chunks", "id long, workspace_id long, chunk_id string, text string")
    known = spark.createDataFrame([(1,)], "id long")
    for run in range(2):
        ingest_stream(read_files(spark, str(tmp_path / "in"), 1, streaming=True), documents, chunks, str(tmp_path / f"check{run}"), known, rejected, name=f"run {run}").awaitTermination()
        rows = documents.read().collect()
        assert {r.status for r in rows} == {"COMPLETED"} and sorted(r.document_id for r in rows) == [1, 2, 3] and all(r.created_at <= r.updated_at for r in rows)
        assert chunks.read().count() == 3
        first = {r.document_id: r.created_at for r in rows} if run == 0 else first
    assert first == {r.document_id: r.created_at for r in rows} and any(r.updated_at > r.created_at for r in rows)
    assert [(r.filename, r.error_code) for r in rejected.read().collect()] == [("x.doc", "UNSUPPORTED_TYPE")]
    ingest_stream(read_files(spark, str(tmp_path / "in"), 9, streaming=True), documents, chunks, str(tmp_path / "check9"), known, rejected, name="run 9").awaitTermination()
    assert documents.read().count() == 3 and {r.error_code for r in rejected.read([9]).collect()} == {"WORKSPACE_NOT_FOUND", "UNSUPPORTED_TYPE"}


def test_documents_that_cannot_be_indexed_fail_and_keep_their_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, body in enumerate(["fine", "short"]):
        (tmp_path / "in" / f"f{i}.md").write_text(body)
    store = Store(spark, str(tmp_path / "store"))
    documents, chunks = Table(store, "documents", DOCUMENTS), Table(store, "chunks", "id long, workspace_id long, text string")
    points = Table(store, "points", "point_id long, workspace_id long, vector array<double>, payload struct<workspace_id:long,document_id:long,chunk_id:string,chunk_index:int,section:string,document_name:string,source_type:string,page_start:int,page_end:int>")
    ingest_stream(read_files(spark, str(tmp_path / "in"), 1, streaming=True), documents, chunks, str(tmp_path / "check"), points=points, embedder=FixedEmbedder(8), dimension=8).awaitTermination()
    got = {r.filename: (r.status, r.error_message) for r in documents.read().collect()}
    assert got == {"f0.md": ("COMPLETED", None), "f1.md": ("FAILED", "embedding dimension mismatch: expected 8, got 2")}
    assert chunks.read().count() == 2 and [r.payload.document_name for r in points.read().collect()] == ["f0.md"]


def test_store_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, other = Table(store, "one", "id long, workspace_id long, v string"), Table(store, "other", "id long, workspace_id long")
    frame = lambda rows: spark.createDataFrame(rows, "id long, workspace_id long, v string")
    assert one.read().count() == 0 and store.state() == (0, {})
    one.upsert(frame([(1, 1, "a"), (2, 2, "b"), (3, None, "c")]), "id")
    before = store.state()[1]["one"]
    one.upsert(frame([(2, 2, "x"), (4, 2, "y")]), "id")
    after = store.state()[1]["one"]
    assert {w for w in after if after[w] != before.get(w)} == {2}
    assert {r.id: r.v for r in one.read().collect()} == {1: "a", 2: "x", 3: "c", 4: "y"} and other.read().count() == 0
    one.upsert(frame([]), "id")
    n = store.state()[0]
    assert n == 2
    late = Store(spark, str(tmp_path / "s"))
    late.state = lambda: (n - 1, {})
    with pytest.raises(Conflict):
        Table(late, "one", "id long, workspace_id long, v string").publish(frame([(9, 9, "lost")]))
    assert one.read().count() == 4
    one.publish(frame([(5, 5, "z")]))
    assert [r.id for r in one.read().collect()] == [5]


def with_stand_in(pages):
    """pages over a stand-in for pypdf: form feeds part pages, and some files and pages can't be read."""

    def run(batches):
        import sys
        import types

        class Page:
            def __init__(self, data):
                self.data = data

            def extract_text(self):
                return self.data.decode()

        class PdfReader:
            def __init__(self, stream):
                data = stream.read()
                if data.startswith(b"broken"):
                    raise OSError("no PDF")
                self.is_encrypted = data.startswith(b"locked")
                self.metadata = types.SimpleNamespace(title=" Named ")
                self.pages = [Page(x) for x in data.split(b"\f")]

        held = sys.modules.get("pypdf")
        sys.modules["pypdf"] = types.SimpleNamespace(PdfReader=PdfReader)
        try:
            yield from pages(batches)
        finally:
            sys.modules.pop("pypdf") if held is None else sys.modules.update(pypdf=held)

    return run


def test_streamed_pdfs_keep_their_text_and_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_pages", with_stand_in(files._pages))
    (tmp_path / "in").mkdir()
    contents = {"good.pdf": b"one\ftwo", "partial.pdf": b"one\f\xff\fthree", "broken.pdf": b"broken", "locked.pdf": b"locked", "blank.pdf": b" ", "note.md": b"# T\n\nbody\n"}
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    store = Store(spark, str(tmp_path / "store"))
    documents = Table(store, "documents", DOCUMENTS)
    chunks = Table(store, "chunks", "id long, workspace_id long, document_name string, text string, page_start int, page_end int")
    ingest_stream(read_files(spark, str(tmp_path / "in"), 1, streaming=True), documents, chunks, str(tmp_path / "check")).awaitTermination()
    assert {r.filename: (r.status, r.error_message) for r in documents.read().collect()} == {
        "good.pdf": ("COMPLETED", None), "partial.pdf": ("PARTIAL", "Text extraction failed for pages: 2"), "broken.pdf": ("FAILED", files.UNREADABLE),
        "locked.pdf": ("FAILED", files.ENCRYPTED), "blank.pdf": ("FAILED", ingest.NO_CHUNKS), "note.md": ("COMPLETED", None),
    }
    assert {(r.document_name, r.text, r.page_start, r.page_end) for r in chunks.read().collect()} == {("good.pdf", "one\n\ntwo", 1, 2), ("partial.pdf", "one\n\nthree", 1, 3), ("note.md", "T\n\nbody", None, None)}


def test_unreadable_pdfs_do_not_stop_the_others(spark, monkeypatch):
    monkeypatch.setattr(files, "_pages", with_stand_in(files._pages))
    rows = spark.createDataFrame([(1, b"broken"), (2, b"one\ftwo"), (3, b"locked")], "document_id long, content binary").coalesce(1)
    got = sorted(map(tuple, files.pdf_pages(rows).collect()), key=str)
    assert got == [(1, None, files.UNREADABLE, True, None), (2, 1, "one", False, "Named"), (2, 2, "two", False, "Named"), (3, None, files.ENCRYPTED, True, None)]


def test_once_writes_a_table_again_only_in_another_state_or_without_it(spark, tmp_path):
    from docquery.sources.scratch import file_state, once

    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    rows = lambda state: once(spark, f"once-{tmp_path.name}", (state,), make)
    assert [rows(1).count(), rows(1).count(), rows(2).count(), rows(1).count()] == [1, 1, 2, 1]
    path = next(iter(rows(1).inputFiles())).removeprefix("file://").rsplit("/", 1)[0]
    Path(path, "_SUCCESS").unlink()
    assert rows(1).count() == 3
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = file_state(spark.read.parquet(f"{tmp_path}/t"))
    assert before == file_state(spark.read.parquet(f"{tmp_path}/t"))
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert before != file_state(spark.read.parquet(f"{tmp_path}/t"))

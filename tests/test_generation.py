import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docquery.operators import answering
from docquery.operators.generation import FAILED, LATE, Chat, FirstSentence, read_replies, replies
from docquery.operators.service import BAD_QUESTION, Service
from docquery.operators.vectors import HashEmbedder
from docquery.sources.repository import PAYLOAD, VectorRepository

GOOD = '{"text": " a ", "cited_source_ids": ["SOURCE_1"], "refused": false}'


def moods():
    """A provider of this module's own, which the tasks get by value."""

    class Moods:
        def generate(self, system_prompt, user_prompt):
            import time

            assert "cited_source_ids" in system_prompt
            if user_prompt == "sleep":
                time.sleep(30)
            if user_prompt == "fail":
                raise OSError("secret address")
            return {"none": None, "bad": "{", "number": 7}.get(user_prompt, '{"text": " a ", "cited_source_ids": ["SOURCE_1"], "refused": false}')

    return Moods()


def test_each_row_says_how_it_went(spark):
    rows = [(1, "fine"), (2, "sleep"), (3, "fail"), (4, None), (5, "bad"), (6, "none"), (7, "number"), (8, "fine"), (1 << 60, "fine")]
    said = replies(spark.createDataFrame(rows, "query_id long, prompt string").coalesce(1), moods(), seconds=2.0, at_once=3).cache()
    got = {r.query_id: (r.outcome, r.problem) for r in said.collect()}
    fine = ("reply", None)
    assert got == {1: fine, 2: ("timeout", LATE), 3: ("error", f"{FAILED}: OSError"), 5: fine, 6: ("error", FAILED), 7: ("error", FAILED), 8: fine, 1 << 60: fine}
    read = {r.query_id: (r.text, r.error_message) for r in read_replies(said).collect()}
    assert read[1] == ("a", None) and read[2] == (None, LATE) and read[3] == (None, f"{FAILED}: OSError") and read[5] == (None, answering.NO_REPLY)
    questions = spark.createDataFrame([(i,) for i in read], "query_id long")
    found = spark.createDataFrame([(i, "SOURCE_1", True) for i in read], "query_id long, source_id string, included boolean")
    codes = {r.query_id: r.error_code for r in answering.answers(questions, questions, found, read_replies(said)).collect()}
    assert codes == {1: None, 2: "LLM_INVALID", 3: "LLM_INVALID", 5: "LLM_INVALID", 6: "LLM_INVALID", 7: "LLM_INVALID", 8: None, 1 << 60: None}


def test_first_sentence_of_the_first_source():
    block = lambda n, text: f"[SOURCE_{n}]\ndocument: d\npage: N/A\nsection: a > b\nchunk_id: c\ncontent:\n{text}"
    prompt = "\n\n".join(["Question:", "why", "Sources:", block(1, "One\n\nthing. More."), block(2, "Two."), block(3, "x"), answering.INSTRUCTION])
    assert json.loads(FirstSentence().generate("", prompt)) == {"text": "One\n\nthing", "cited_source_ids": ["SOURCE_1", "SOURCE_2"], "refused": False}
    alone = "\n\n".join(["Question:", "why", "Sources:", block(1, "no stop"), answering.INSTRUCTION])
    assert json.loads(FirstSentence().generate("", alone))["text"] == "no stop"
    assert json.loads(FirstSentence().generate("", "nothing"))["refused"] is True


def test_chat_over_http(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            broken = body["messages"][1]["content"] == "broken"
            self.send_response(500 if broken else 200)
            self.end_headers()
            self.wfile.write(b"" if broken else json.dumps({"choices": [{"message": {"content": GOOD}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        chat = Chat(f"http://127.0.0.1:{server.server_port}/", " key ", "m", 10)
        rows = spark.createDataFrame([(1, "hello"), (2, "broken")], "query_id long, prompt string")
        got = {r.query_id: (r.reply, r.problem) for r in replies(rows, chat).collect()}
        assert got == {1: (GOOD, None), 2: (None, f"{FAILED}: HTTPError")}
        path, key, body = next(x for x in asked if x[2]["messages"][1]["content"] == "hello")
        assert path == "/chat/completions" and key == "Bearer key" and body["response_format"] == {"type": "json_object"} and body["model"] == "m"
        server.shutdown()
        assert {r.problem for r in replies(rows, Chat("http://127.0.0.1:9", "k", "m", 1)).collect()} == {f"{FAILED}: URLError"}
    finally:
        server.server_close()
    with pytest.raises(ValueError, match="empty"):
        Chat("http://x", " ", "m")


def test_questions_are_checked_before_anything_is_embedded_or_asked(spark, tmp_path):
    embedder, asked = HashEmbedder(16), []

    class Watched(HashEmbedder):
        def queries(self, df, text):
            asked.extend(r.query_id for r in df.collect())
            return super().queries(df, text)

    chunks = [(i, 1 + i % 2, f"c{i}", "d.md", f"topic{i} words about topic{i}. More.") for i in range(1, 7)]
    texts = spark.createDataFrame(chunks, "chunk_db_id long, workspace_id long, chunk_id string, document_name string, text string")
    stored = texts.selectExpr("chunk_db_id", "workspace_id", "chunk_id", "7L as document_id", "document_name", "'markdown' as source_type", "0 as chunk_index", "null as section", "null as page_start", "null as page_end", "text")
    points = embedder.passages(stored.withColumnRenamed("chunk_db_id", "point_id"), "text").selectExpr("point_id", "vector", f"cast(struct(workspace_id, document_id, chunk_id, chunk_index, section, document_name, source_type, page_start, page_end) as {PAYLOAD}) as payload")
    repository = VectorRepository(spark, str(tmp_path / "v"), 16)
    repository.ensure()
    repository.upsert(points)
    rows = [(1, 1, "topic2 words"), (2, 2, " "), (3, 0, "x"), (4, 9, "x"), (5, 1, "y" * 1001), (6, 3, "nothing stored here"), (7, None, "x"), (8, 2, None)]
    questions = spark.createDataFrame(rows, "query_id long, workspace_id long, question string")
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    answers, cited = Service(repository, stored, known, Watched(16), FirstSentence(), k=1).answer(questions)
    got = {r.query_id: (r.answer, r.refused, r.error_code, r.error_message) for r in answers.collect()}
    assert got[1] == ("topic2 words about topic2", False, None, None) and got[6] == (answering.REFUSAL, True, None, None)
    assert {i: got[i][2] for i in (2, 3, 4, 5, 7, 8)} == {2: "INVALID_INPUT", 3: "INVALID_INPUT", 4: "WORKSPACE_NOT_FOUND", 5: "INVALID_INPUT", 7: "INVALID_INPUT", 8: "INVALID_INPUT"}
    assert got[2][3] == BAD_QUESTION and got[4][3] == "Workspace 9 does not exist." and sorted(asked) == [1, 6]
    assert [(r.query_id, r.quote) for r in cited.collect()] == [(1, "topic2 words about topic2. More.")] and "chunk_db_id" not in cited.columns

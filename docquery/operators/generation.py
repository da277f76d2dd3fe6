"""The boundary to a language model: a provider answers prompts row by row, and each row says how it went."""

from __future__ import annotations

import functools
import json
import re
import threading
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.operators.answering import parsed_reply

SYSTEM_PROMPT = """Answer the question from the numbered sources alone, without other knowledge.
Cite sources by their exact identifiers, such as SOURCE_1, and never one that is not given.
If the sources do not suffice, refuse and cite nothing.
Reply with one JSON object: "text" (a string), "cited_source_ids" (an array of identifiers), "refused" (true or false)."""
REPLY, ERROR, TIMEOUT = "reply", "error", "timeout"
FAILED, LATE = "the model request failed", "the model did not reply in time"
#: Seconds that a reply may take; prompts that a task has under way at once.
SECONDS, AT_ONCE = 60.0, 8
REPLIES = "query_id long, reply string, outcome string, problem string"


class Provider(Protocol):
    """Generates the reply to one prompt; it is pickled to the tasks and called from several threads."""

    def generate(self, system_prompt: str, user_prompt: str) -> str: ...


class FirstSentence:
    """Needs no model: the first sentence of the first source, citing the first two."""

    BLOCK = re.compile(r"\[(SOURCE_\d+)\]\ndocument: .*\npage: .*\nsection: .*\nchunk_id: .*\ncontent:\n")

    def generate(self, system_prompt: str, user_prompt: str) -> str:
        ids = [m[1] for m in self.BLOCK.finditer(user_prompt)]
        if not ids:
            return json.dumps({"text": "", "cited_source_ids": [], "refused": True})
        first = user_prompt[self.BLOCK.search(user_prompt).end() :]
        after = self.BLOCK.search(first)
        text = first[: after.start()].rstrip() if after else first.rsplit("\n\n", 1)[0]
        return json.dumps({"text": text.split(".", 1)[0], "cited_source_ids": ids[:2], "refused": False})


class Chat:
    """A chat-completions service over HTTP; the reply is the content of the first choice."""

    def __init__(self, url: str, key: str, model: str, seconds: float = SECONDS):
        if not (url.strip() and key.strip() and model.strip()):
            raise ValueError("url, key and model must not be empty")
        self.url, self.key, self.model, self.seconds = url.rstrip("/"), key.strip(), model.strip(), seconds

    def generate(self, system_prompt: str, user_prompt: str) -> str:
        messages = [{"role": "system", "content": system_prompt}, {"role": "user", "content": user_prompt}]
        body = {"model": self.model, "messages": messages, "response_format": {"type": "json_object"}, "temperature": 0}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.seconds) as found:
            return json.load(found)["choices"][0]["message"]["content"]


def _call(provider: Provider, prompt: str, out: list, at: int) -> None:
    try:
        reply = provider.generate(SYSTEM_PROMPT, prompt)
        out[at] = (reply, REPLY, None) if isinstance(reply, str) else (None, ERROR, FAILED)
    except Exception as e:  # a row that fails is reported, the others go on
        out[at] = (None, ERROR, f"{FAILED}: {type(e).__name__}")


def _ask(batches: Iterator[pa.RecordBatch], provider: Provider, seconds: float, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prompts, out = batch.column("query_id"), batch.column("prompt").to_pylist(), []
        for begin in range(0, len(prompts), at_once):
            some: list = [None] * len(prompts[begin : begin + at_once])
            calls = [threading.Thread(target=_call, args=(provider, p, some, i), daemon=True) for i, p in enumerate(prompts[begin : begin + at_once])]
            for c in calls:
                c.start()
            over = time.monotonic() + seconds
            for c in calls:
                c.join(max(0.0, over - time.monotonic()))
            out += [x or (None, TIMEOUT, LATE) for x in list(some)]
        columns = [pa.array([r[i] for r in out], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], ["query_id", "reply", "outcome", "problem"])


def replies(prompts: DataFrame, provider: Provider, seconds: float = SECONDS, at_once: int = AT_ONCE, tasks: int | None = None) -> DataFrame:
    """query_id, reply, outcome (reply, error or timeout), problem of prompts (query_id, prompt); null prompts are not asked.

    A prompt whose call fails or takes longer than `seconds` says so and stops
    no other. Calls wait for a service, so prompts are dealt into `tasks` tasks,
    with at_once calls each; a task that is run again asks again: write the
    result before using it twice.
    """
    asked = prompts.where("prompt is not null").select("query_id", "prompt")
    dealt = asked.repartition(tasks) if tasks else asked
    return dealt.mapInArrow(functools.partial(_ask, provider=provider, seconds=seconds, at_once=at_once), REPLIES)


def read_replies(found: DataFrame) -> DataFrame:
    """Replies with their fields (see parsed_reply); a failed or late one has its problem as error_message."""
    return parsed_reply(found).withColumn("error_message", F.coalesce("problem", "error_message")).drop("problem", "outcome")

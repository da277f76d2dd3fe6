"""Batches of questions from the check of their input to answers with citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.operators import answering
from docquery.operators.generation import AT_ONCE, SECONDS, Provider, read_replies, replies
from docquery.operators.ingest import in_known_workspaces
from docquery.operators.vectors import TOP_K, EmbeddingProvider, checked_queries
from docquery.sources.repository import VectorRepository
from docquery.sources.scratch import written

# Fixed value: a message.
BAD_QUESTION = "question must have 1 to 1000 characters and a positive workspace_id"


@dataclass(frozen=True)
class Service:
    """What answering needs: the collection of points, stored chunks (as stored_chunks() gives them), known workspaces (id), an embedder and a model."""

    repository: VectorRepository
    stored: DataFrame
    workspaces: DataFrame
    embedder: EmbeddingProvider
    provider: Provider
    k: int = TOP_K
    seconds: float = SECONDS
    at_once: int = AT_ONCE
    tasks: int | None = None

    def answer(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, answer, refused, cited, error_code, error_message) of every question, and the citations as shown to users.

        questions: query_id (without repeats), workspace_id, question. What is
        wrong with a question, its workspace, the stored chunks or the model's
        reply is an error_code of that question; others go on. Only questions
        that pass the checks are embedded, and only those with a context are
        put to the model.
        """
        seen = in_known_workspaces(checked_queries(questions.select("query_id", "workspace_id", "question")), self.workspaces)
        code = F.coalesce("error_code", "workspace_error")
        lost = F.concat(F.lit("Workspace "), F.coalesce(F.col("workspace_id").cast("string"), F.lit("null")), F.lit(" does not exist."))
        seen = written(seen.withColumn("error_message", F.when(F.col("error_code").isNotNull(), BAD_QUESTION).when(F.col("workspace_error").isNotNull(), lost)).withColumn("error_code", code), "questions")
        good = seen.where("error_code is null").select("query_id", "workspace_id", "question")
        hits = self.repository.search(self.embedder.queries(good, "question"), self.k).select("query_id", "workspace_id", "point_id", "score", "rank")
        found = written(answering.sources(answering.hydrated(hits, self.stored)), "sources")
        prompts = answering.packed(found).join(good, "query_id").select("query_id", answering.prompt(F.col("question"), F.col("prompt_context")).alias("prompt"))
        said = written(read_replies(replies(prompts, self.provider, self.seconds, self.at_once, self.tasks)), "replies")
        answers = answering.answers(good, hits, found, said)
        wrong = seen.where("error_code is not null").select("query_id", "error_code", "error_message")
        cited = answering.citations(said.join(answers.where("error_code is null").select("query_id"), "query_id", "left_semi"), found)
        return answers.unionByName(wrong, allowMissingColumns=True), answering.public(cited)

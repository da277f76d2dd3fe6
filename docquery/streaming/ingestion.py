"""The batch ingestion, run on each micro-batch of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquery.operators.indexing import embedded, indexed
from docquery.operators.ingest import checked, chunk_rows, failed, parsed, pending
from docquery.operators.numbering import numbered
from docquery.operators.parsers import Registry, registry
from docquery.operators.vectors import EmbeddingProvider
from docquery.sources.files import pdf_pages
from docquery.sources.store import Table, upsert_together


#: Commits of a micro-batch.
STEPS = 3


def with_document_ids(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files (file_key, ...) with document_id: that of the stored document with the same key, or the next free ones in the order of keys."""
    known = documents.select("file_key", F.col("document_id").alias("stored"))
    last = documents.agg(F.coalesce(F.max("document_id"), F.lit(0))).first()[0]
    keys = files.select("file_key").distinct().join(known, "file_key", "left")
    fresh = numbered(keys.where("stored is null").select("file_key"), ["file_key"], "document_id", last + 1)
    ids = keys.where("stored is not null").select("file_key", F.col("stored").alias("document_id")).unionByName(fresh)
    return files.dropDuplicates(["file_key"]).join(ids, "file_key")


def ingest_stream(
    files: DataFrame, documents: Table, chunks: Table, checkpoint: str, workspaces: DataFrame | None = None, rejected: Table | None = None,
    points: Table | None = None, embedder: EmbeddingProvider | None = None, dimension: int = 64, name: str = "ingest", parsers: Registry | None = None,
) -> StreamingQuery:
    """Documents and chunks of arriving files, and their points where an embedder is given; all tables are of one store. Files are read by Markdown and PDF parsers, or by those given.

    A micro-batch is three commits: files that are rejected, to `rejected` and
    nowhere else, with the others as PENDING; their final state and chunks; and
    points with the documents that can't be indexed, which are FAILED and keep
    their chunks. Each commit notes, with the rows, how far which batch of the
    stream `name` has come: a batch that is run again after a failure goes on
    after its last commit, and one that was finished changes nothing. A stream
    that starts from a new checkpoint needs a new name.
    """

    known = parsers or registry(pdf_pages)

    def batch(rows: DataFrame, number: int) -> None:
        done = documents.store.mark(name)
        step = lambda i: STEPS * number + i
        if done >= step(STEPS - 1):
            return
        seen = checked(rows, workspaces, known).persist()
        good = seen.where("error_code is null").select(rows.columns)
        taken = with_document_ids(good, documents.read()).persist()
        try:
            if done < step(0):
                bad = [(rejected, seen.where("error_code is not null").drop("content"), "file_key")] if rejected is not None else []
                upsert_together([*bad, (documents, pending(checked(taken, parsers=known)), "document_id")], marks={name: step(0)})
            read = parsed(taken, parsers=known).persist()
            new = chunk_rows(read).persist()
            if done < step(1):
                upsert_together([(documents, read, "document_id"), (chunks, new, "id")], marks={name: step(1)})
            if embedder is not None and points is not None:
                vectors = embedded(new, embedder, dimension).persist()
                found, errors = indexed(vectors, read.where("status <> 'FAILED'"))
                lost = failed(documents.read().join(errors.select("document_id"), "document_id", "left_semi"), errors)
                upsert_together([(points, found.withColumn("workspace_id", F.col("payload.workspace_id")), "point_id"), (documents, lost, "document_id")], marks={name: step(2)})
                vectors.unpersist()
            else:
                upsert_together([], marks={name: step(2)}, store=documents.store)
            read.unpersist()
            new.unpersist()
        finally:
            taken.unpersist()
            seen.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

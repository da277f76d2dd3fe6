"""WARC archives as tables of record chunks.

Writing: a page becomes a WARC/1.1 record, and a payload over CHUNK bytes a
segmented one (a first record and continuations), a row each, so that no
header or block over CHUNK bytes is laid out. A payload of at least REVISIT
bytes that another page has too is stored once, with the smallest page_id; the
others are revisit records. What is shared is found from digests alone.
Spark's text writer stores the records in any file system that Spark writes
to; a file is one gzip stream (.txt.gz), without a warcinfo record.

Reading: Spark's text reader inflates files as a stream of pieces between blank
lines, none longer than a chunk; tasks turn them into rows of record and chunk
number, each with the digest of the payload up to its end. Neither an archive
nor a payload is put together. The digest after the last chunk is checked
against the record's header.

A null payload is empty. A null url has no target URI. Pages without page_id
are records without a page; they never are what others revisit, unless no page
with that payload has an id: then all its records are responses. Rows that
repeat the page_id and payload of a response are responses too.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.batches import batches_of
from docquery.llm.storage import fresh_path, written

CHUNK, REVISIT = 1 << 17, 100
#: Shared digests that may be broadcast (under 64 bytes each); beyond, those that hold over 1/HOT of all pages, of which there are HOT at most; pieces handed to Python at a time.
BROADCAST_DIGESTS, HOT, PIECES = 1 << 20, 4096, 1024
DATE, END = "1970-01-01T00:00:00Z", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, record long, chunk int, page_id long, record_type string, refers_to long, header_digest string, header_bytes long, n_bytes long, running_digest string, data binary"


def _records(pages: DataFrame, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Pages with payload, its digest and length, and the page that it revisits. Payloads are shuffled only where more digests are shared than may be broadcast."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    counted = facts.where(F.col("bytes") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(counted.where("n > 1 and first is not null"), "warc-shared")
    if shared.count() <= broadcast_digests:
        joined = facts.join(F.broadcast(shared.select("digest", "first")), "digest", "left")
    else:
        total = pages.count()
        hot = facts.join(F.broadcast(shared.where(F.col("n") * HOT > total).select("digest", F.col("first").alias("hot"))), "digest", "left")
        rest = hot.where("hot is null").join(shared.where(F.col("n") * HOT <= total).select("digest", "first"), "digest", "left")
        joined = hot.where("hot is not null").withColumn("first", F.col("hot")).unionByName(rest).drop("hot")
    return joined.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    rows = _records(pages).withColumn("seq", F.monotonically_increasing_id())
    revisit = F.col("refers_to").isNotNull()
    segments = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk)).cast("int"))
    rows = rows.withColumn("segments", segments)
    blocks = F.transform(F.sequence(F.lit(1), F.col("segments")), lambda i: F.when(revisit, F.lit(b"")).otherwise(F.substring(F.col("payload"), (i - 1) * chunk + 1, F.lit(chunk))))
    # the payload itself is not copied to each of its segments
    rows = rows.select(*[c for c in rows.columns if c != "payload"], F.posexplode(blocks).alias("segment", "block")).withColumn("segment", F.col("segment") + 1)
    urn = lambda segment: F.format_string("<urn:record:%d:%d>", F.col("seq"), segment)
    head, several = F.col("segment") == 1, F.col("segments") > 1
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(~head, "continuation").when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("segment"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To-Page", F.col("refers_to")),
        _line("WARC-Segment-Number", F.when(several, F.col("segment"))),
        _line("WARC-Segment-Origin-ID", F.when(several & ~head, urn(F.lit(1)))),
        _line("WARC-Segment-Total-Length", F.when(several & (F.col("segment") == F.col("segments")), F.col("bytes"))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    whole = F.concat(F.encode(header, "UTF-8"), F.col("block")).cast("string")
    rows.select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Takes lines and counted bytes off a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def header(self) -> dict[str, str] | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a header")
                return None
        lines = self.held[:end].decode().split("\r\n")
        del self.held[: end + 4]
        if not lines[0].startswith("WARC/1."):
            raise ValueError("a record has no WARC version line")
        return dict(line.split(": ", 1) for line in lines[1:])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("an archive ends within a block")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def chunk_rows(archive: str, pieces: Iterator[bytes], data: bool) -> Iterator[tuple]:
    """The rows of CHUNKS of one archive, in order, from the bytes of its records in pieces."""
    reader, number, digest, chunk = _Reader(pieces), -1, None, 0
    as_int = lambda x: None if x is None else int(x)
    while (head := reader.header()) is not None:
        if head["WARC-Type"] != "continuation":
            number, digest, chunk, kind = number + 1, hashlib.sha256(), 0, head["WARC-Type"]
        fixed = (as_int(head.get("WARC-Page-ID")), kind, as_int(head.get("WARC-Refers-To-Page")), head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"]))
        size, held = int(head["Content-Length"]), []
        for part in reader.take(size) if size else [b""]:
            digest.update(part)
            if data:
                held.append(part)
        yield (archive, number, chunk, *fixed, size, digest.hexdigest(), b"".join(held) if data else None)
        chunk += 1
        if b"".join(reader.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")


def _chunks(batches: Iterator[pd.DataFrame], data: bool) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in CHUNKS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
    pieces = ((path, piece + END.encode()) for batch in batches for path, piece in zip(batch["path"], batch["piece"], strict=True))
    for archive, own in itertools.groupby(pieces, key=lambda x: x[0]):  # a task reads its files one after another
        rows, held = [], 0
        for row in chunk_rows(archive, (piece for _, piece in own), data):
            rows.append(row)
            held += row[8] * data
            if len(rows) >= 4096 or held >= 8 << 20:
                yield frame(rows)
                rows, held = [], 0
        if rows:
            yield frame(rows)


def read_chunks(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """Rows of CHUNKS of all archives in a folder, a chunk per segment; data = False leaves the bytes out."""
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(functools.partial(_chunks, data=data), CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; fails where a payload is not what its header says."""
    with batches_of(spark, PIECES):
        chunks = written(read_chunks(spark, path, data=False).drop("data"), "warc-chunks")
    rows = chunks.groupBy("archive", "record").agg(
        *[F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "header_digest", "header_bytes")],
        F.sum("n_bytes").alias("n_bytes"),
        F.max_by("running_digest", "chunk").alias("found"),
    )
    held = F.col("record_type") == "response"
    wrong = held & ((F.col("found") != F.col("header_digest")) | (F.col("n_bytes") != F.col("header_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its header: "), F.col("archive")))).otherwise(F.col("header_digest"))
    return rows.select("page_id", F.col("header_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_records(spark, path)

"""Suffix-array deduplication of long byte strings by prefix doubling over sampled positions.

The scanning task builds ranks of prefixes of 8, 16, ... 256 bytes by doubling
(the rank of a 2h-byte prefix comes from the ranks of two h-byte prefixes h
apart) and keeps one position per run of windows, the least-ranked one. Spark
then sorts and reranks, at growing offsets:
1. positions by their 256-byte rank: unique ones drop out;
2. by that rank and the rank of all text of their run: equal pairs are past
   the threshold, whatever the window;
3. every window start of what is left, by its 256-byte ranks at offsets 0 and
   144, which together span the threshold.
Ranks are 64-bit hashes rather than ordinals, pairs of them identify a string.

Null and empty texts have no bytes. Texts shorter than the threshold lose
nothing. Repeated rows count as copies of each other. Texts that share a
doc_id are documents of their own, and so are those without doc_id.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.hashing import LOAD, byte_ranks
from docquery.llm.identity import with_row
from docquery.llm.repeats import Rule, applied, merged, repeated_windows

LENGTH, ANCHOR = 400, 256
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def text_ranks(text: str | None) -> np.ndarray:
    return byte_ranks((text or "").encode())


def byte_rule(length: int = LENGTH, anchor: int = ANCHOR) -> Rule:
    """Windows of `length` bytes; length and anchor are LOAD bytes at least."""
    if length < LOAD or anchor < LOAD:
        raise ValueError(f"length and anchor must be {LOAD} bytes at least")
    return Rule(length, min(anchor, length), False, text_ranks, LOAD)


def _kept(text: str | None, gone, rule: Rule) -> tuple[bytes, list[bytes], int, int]:
    data = (text or "").encode()
    if gone is None or not len(gone) or len(data) < rule.length:
        return data, [data], 0, 0
    begin, end = merged(np.array([x["at"] for x in gone]), np.array([x["n"] for x in gone]), rule, len(data))
    edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(data)]
    return data, [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)], int((end - begin).sum()), len(begin)


def _digests(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch["doc_id"], batch["text"], batch["gone"], strict=True):
            data, parts, removed, n = _kept(text, gone, rule)
            digest = hashlib.sha256()
            for part in parts:
                digest.update(part)
            rows.append((doc, len(data), removed, n, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def _texts(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [None if text is None else b"".join(_kept(text, gone, rule)[1]).decode(errors="replace") for text, gone in zip(batch["text"], batch["gone"], strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})


def _key() -> Column:
    """doc_id, and for rows without one a negative hash of the text."""
    return F.coalesce("doc_id", -2 - F.shiftrightunsigned(F.xxhash64("text"), 2))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id (or what stands for it), row and the windows of `length` bytes that start anywhere else too, as (at, n); docs as with_row() gives them."""
    return repeated_windows(docs.select(_key().alias("doc_id"), "row", "text"), byte_rule(length, anchor), "suffix")


def dedup_texts(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id and the text without its repeated strings; a character cut in two becomes U+FFFD."""
    rule, docs = byte_rule(length, anchor), with_row(docs.select("doc_id", "text"))
    return applied(docs, repeated_spans(docs, length, anchor), functools.partial(_texts, rule=rule), "doc_id long, text string", _key())


def dedup_digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what is kept."""
    rule, docs = byte_rule(length, anchor), with_row(docs.select("doc_id", "text"))
    return applied(docs, repeated_spans(docs, length, anchor), functools.partial(_digests, rule=rule), DIGEST, _key())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

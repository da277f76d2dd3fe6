"""Substring deduplication by seed and extend over words.

Documents meet on winnowed anchors (the least 8-word seed of every 20-word
window). A match is extended both ways as far as its seed stays the window's
anchor; matches equal in that whole extent are decided at once, others window
by window, and adjoining windows merge into maximal repeats.

The earliest occurrence, by doc_id and then place, stays. Null and empty
texts have no words; texts shorter than a window lose nothing. Equal rows are
the same document, so neither is earlier than the other; of different texts
that share a doc_id, the one with the smaller hash is earlier. Rows without
doc_id lose nothing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from docquery.llm.hashing import words
from docquery.llm.identity import with_row
from docquery.llm.repeats import Rule, applied, merged, repeated_windows

LENGTH, SEED = 20, 8
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_ranks(text: str | None) -> np.ndarray:
    return words((text or "").encode())[0]


def word_rule(length: int = LENGTH, seed: int = SEED) -> Rule:
    return Rule(length, min(seed, length), True, word_ranks)


def _kept(text: str | None, gone, rule: Rule) -> tuple[int, list[bytes]]:
    tokens = (text or "").encode().split()
    if gone is None or not len(gone) or len(tokens) < rule.length:
        return len(tokens), tokens
    begin, end = merged(np.array([x["at"] for x in gone]), np.array([x["n"] for x in gone]), rule, len(tokens))
    edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(tokens)]
    return len(tokens), [t for a, b in zip(edges[::2], edges[1::2], strict=True) for t in tokens[a:b]]


def _digests(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch["doc_id"], batch["text"], batch["gone"], strict=True):
            n, kept = _kept(text, gone, rule)
            rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})


def _texts(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [None if text is None else b" ".join(_kept(text, gone, rule)[1]).decode() for text, gone in zip(batch["text"], batch["gone"], strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})


def repeated_passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, row and the windows of `length` words that start earlier too, as (at, n); docs as with_row() gives them."""
    return repeated_windows(docs, word_rule(length, seed), "substring")


def dedup_texts(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id and the kept words joined by spaces; null stays null."""
    rule, docs = word_rule(length, seed), with_row(docs.select("doc_id", "text"))
    return applied(docs, repeated_passages(docs, length, seed), functools.partial(_texts, rule=rule), "doc_id long, text string")


def dedup_digests(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the kept words joined by spaces."""
    rule, docs = word_rule(length, seed), with_row(docs.select("doc_id", "text"))
    return applied(docs, repeated_passages(docs, length, seed), functools.partial(_digests, rule=rule), DIGEST)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

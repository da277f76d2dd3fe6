"""Equal windows of a fixed length across documents, without all pairs.

Shared by the suffix-array and the seed-and-extend deduplication, which bring
their own symbols (bytes, words), lengths and rules for what goes.

A window of `length` symbols is anchored at its least-ranked `anchor`-gram.
Neighbouring windows share anchors, so a document becomes a short sequence of
runs (windows with one anchor position). Equal windows have equal anchors at
equal offsets, therefore:

1. runs whose anchor rank is unique hold no repeated window and drop out;
2. runs equal as a whole (anchor and all the text of their windows) form a
   class; all its windows repeat;
3. only where one anchor has several classes do windows have to be ranked one
   by one, for one representative of each class.

Nothing is sampled or capped: every window is decided. Runs that are equal as a
whole are combined in the scanning task first, so whole copies send a row per
scanning task. A passage barely longer than a window in ever other surroundings
makes a class, and so a row, per document; its anchor's rows then meet in one
task, which sorts them on disk.

Runs are equal if the ranks of their anchor and of their whole text are, windows
if two overlapping ranks are: 128 bits of unrelated hashes either way, so that
among 10**14 windows no two that differ are taken for equal but with a
probability of 10**-10.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm.batches import map_rows
from docquery.llm.hashing import U, mix, sliding_min, slices, spans, windows
from docquery.llm.storage import written

#: Symbols of one long document that are worked on at a time, and its share of a 64-bit rank that holds a position.
PIECE, POSITION_BITS = 1 << 22, 23
#: Bytes of text whose runs, and windows whose ranks, are handed on at once.
BATCH_BYTES, TOGETHER = 8 << 20, 1 << 19
RUNS = "anchor long, class long, doc_id long, row long, at long, n int, copies int, sure boolean"
RANKED = "left long, right long, doc_id long, row long, at long, sure boolean"


@dataclasses.dataclass(frozen=True)
class Rule:
    """length: of a window; anchor: of its anchor; keep_first: the earliest occurrence stays; ranks: of all runs of `unit` symbols of a text."""

    length: int
    anchor: int
    keep_first: bool
    ranks: Callable[[str | None], np.ndarray]
    unit: int = 1

    @property
    def half(self) -> int:
        """The greatest power of two below the length: two such runs span a window."""
        return max(self.unit, 1 << (self.length - 1).bit_length() - 1)


def document_runs(ranks: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, ...]]:
    """(anchor rank, class, first window, windows) of a document's runs; long documents in overlapping pieces."""
    out, n = [], len(ranks) + rule.unit - rule.length
    for begin in range(0, max(0, n), PIECE):
        part = ranks[begin : begin + PIECE + rule.length - rule.unit]
        grams = windows(part, rule.anchor, rule.unit)
        packed = grams >> U(POSITION_BITS) << U(POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(packed, rule.length - rule.anchor + 1) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        halves = grams if rule.half == rule.anchor else windows(part, rule.half, rule.unit)
        out.append((grams[at[first]], spans(halves, rule.half, first, last + rule.length), first + begin, last - first + 1))
    return out


def combined(parts: list[tuple[np.ndarray, ...]], rule: Rule) -> pd.DataFrame:
    """Runs of some documents: a row per class with its copies here, and rows that surely repeat."""
    anchor, kind, doc, row, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, row, doc, kind, anchor))
    anchor, kind, doc, row, at, n = (x[order] for x in (anchor, kind, doc, row, at, n))
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])))
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    copies = np.diff(np.concatenate((head, [len(new)])))[group]
    later = ~new & ((doc != doc[head][group]) | (row != row[head][group]) | (at != at[head][group]))
    later |= ~new & (not rule.keep_first)
    keep = new | later
    frame = pd.DataFrame({"anchor": anchor.view(np.int64), "class": kind.view(np.int64), "doc_id": doc, "row": row, "at": at, "n": n.astype(np.int32), "copies": copies.astype(np.int32), "sure": later})[keep]
    # what surely repeats needs no group any more: spread it
    sure = frame["sure"].to_numpy()
    frame.loc[sure, "anchor"] = mix((frame["doc_id"].to_numpy()[sure] * 1_000_003 + frame["at"].to_numpy()[sure]).view(np.uint64)).view(np.int64)
    return frame


def find_runs(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, j in slices([len(t) if t else 1 for t in batch["text"]], BATCH_BYTES):
            parts = []
            for doc, row, text in zip(batch["doc_id"][i:j], batch["row"][i:j], batch["text"][i:j], strict=True):
                for anchor, kind, at, n in document_runs(rule.ranks(text), rule):
                    parts.append((anchor, kind, np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), at, n))
            if parts:
                yield combined(parts, rule)


def rank_windows(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    """Rank pairs (at the window's start, and where a second prefix ends with it) of the windows asked for."""

    def frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        left, right, doc, row, at, sure = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"left": left.view(np.int64), "right": right.view(np.int64), "doc_id": doc, "row": row, "at": at, "sure": sure})

    parts, held = [], 0
    for batch in batches:
        for doc, row, text, asked in zip(batch["doc_id"], batch["row"], batch["text"], batch["asked"], strict=True):
            ranks = rule.ranks(text)
            for run in asked:
                at, n = run["at"], run["n"]
                if at + n + rule.length - rule.unit <= len(ranks):
                    own = windows(ranks[at : at + n + rule.length - rule.unit], rule.half, rule.unit)
                    parts.append((own[:n].copy(), own[rule.length - rule.half :].copy(), np.full(n, doc, np.int64), np.full(n, row, np.int64), np.arange(at, at + n), np.full(n, run["sure"])))
                    held += n
                if held >= TOGETHER:
                    yield frame(parts)
                    parts, held = [], 0
    if parts:
        yield frame(parts)


def merged(at: np.ndarray, n: np.ndarray, rule: Rule, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of symbols that the windows cover."""
    order = np.argsort(at, kind="stable")
    begin, end = at[order], np.minimum(at[order] + n[order] + rule.length - 1, size)
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    return begin[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]


def repeated_windows(docs: DataFrame, rule: Rule, name: str) -> DataFrame:
    """doc_id, row and an array of (at, n): n windows from at that the rule removes; docs have doc_id, row (see identity.py) and text."""
    own = ["doc_id", "row"]
    runs = docs.select(*own, "text").where("doc_id is not null and text is not null").mapInPandas(functools.partial(find_runs, rule=rule), RUNS)
    of_class = Window.partitionBy("anchor", "class")
    of_anchor = Window.partitionBy("anchor")
    place = F.struct(*own, "at")
    ranked = (
        runs.withColumn("first", F.min(place).over(of_class))
        .withColumn("copies", F.sum("copies").over(of_class))
        .withColumn("several", F.min("class").over(of_anchor) != F.max("class").over(of_anchor))
        .withColumn("head", place == F.col("first"))
    )
    goes = F.col("sure") | (~F.col("head") if rule.keep_first else F.col("copies") > 1)
    asks = ~F.col("sure") & F.col("several") & F.col("head")
    found = written(ranked.select(*own, "at", "n", goes.alias("goes"), asks.alias("asks")).where("goes or asks"), f"{name}-runs")

    asked = found.where("asks").groupBy(*own).agg(F.collect_set(F.struct("at", "n", F.col("goes").alias("sure"))).alias("asked"))
    pairs = docs.select(*own, "text").join(asked, own).mapInPandas(functools.partial(rank_windows, rule=rule), RANKED)
    equal = Window.partitionBy("left", "right")
    if rule.keep_first:
        again = pairs.withColumn("first", F.min(place).over(equal)).where(place != F.col("first"))
    else:
        again = pairs.withColumn("copies", F.count("*").over(equal)).where("copies > 1 and not sure")
    single = again.groupBy(*own).agg(F.collect_set("at").alias("at")).select(*own, F.explode("at").alias("at"), F.lit(1).alias("n"))
    return found.where("goes").select(*own, "at", "n").unionByName(single).groupBy(*own).agg(F.collect_list(F.struct("at", "n")).alias("gone"))


def applied(docs: DataFrame, gone: DataFrame, cut: Callable, schema: str, key: Column | None = None) -> DataFrame:
    """Every document (doc_id, row, text) once more, with its windows to remove, through `cut` (batches of doc_id, text, gone); rows without key lose nothing."""
    key = F.col("doc_id") if key is None else key
    rows = docs.select("doc_id", "text", key.alias("key"), "row")
    held = rows.where("key is not null").join(gone.withColumnRenamed("doc_id", "key"), ["key", "row"], "left").drop("key", "row")
    # rows without key would all meet in one task of the join
    return map_rows(held.unionByName(rows.where("key is null").drop("key", "row"), allowMissingColumns=True), cut, schema)

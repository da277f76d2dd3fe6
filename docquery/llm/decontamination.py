"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters, digits and non-ASCII characters.
1. Seeds, the runs of LEAST tokens that a document shares with any test item,
   find candidates; the tokens of an item that seeds cover bound its tiling.
2. Running Karp-Rabin tiles the item with the document's seeded passages:
   repeatedly the longest match whose tokens are all unmarked is marked, once
   the tokens themselves agree.
3. A document is contaminated by an item if tiles cover enough of it, in
   whatever order the passages come.

Items of fewer than LEAST tokens are one seed; items without tokens match
nothing. Null and empty documents match nothing, and so do rows without
doc_id or item_id. Rows that share an id count as one document or item: a
document's passages are put together, and an item's distinct texts, in their
order as strings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.hashing import PUNCTUATION, U, mix, windows, words
from docquery.llm.storage import written

#: Tokens of the shortest tile; share of an item's tokens that makes a document contaminated; seeds that may be broadcast (8 bytes each).
LEAST, COVERAGE_PERCENT, BROADCAST_SEEDS = 5, 60, 1 << 20
#: Moduli and bases of the running fingerprints.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525173))
REPORT = "doc_id long, item_id long, n_tokens int, n_matched int, n_tiles int, longest int, coverage double"


def tokens(text: str | None) -> np.ndarray:
    return words((text or "").encode(), lower=True, between=PUNCTUATION)[0]


def seeds(found: np.ndarray, size: int) -> np.ndarray:
    return mix(windows(found, size) + U(size))


@functools.lru_cache(maxsize=None)
def _powers(base: int, prime: int, bits: int) -> np.ndarray:
    """base**i modulo prime for i < 2**bits."""
    if not bits:
        return np.ones(1, np.uint64)
    low = _powers(base, prime, bits - 1)
    return np.concatenate((low, low * U(pow(base, len(low), prime)) % U(prime)))


class Running:
    """Karp-Rabin fingerprints of a token sequence: of a window of any size in a few operations.

    Prefix sums of two polynomials modulo primes below 2**31, so that products fit in 64 bits.
    """

    def __init__(self, found: np.ndarray):
        self.sums, self.back = [], []
        bits = len(found).bit_length()
        for prime, base in PRIMES:
            up = _powers(base, prime, bits)[: len(found)]
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(found % U(prime) * up % U(prime)) % U(prime))))
            self.back.append(_powers(pow(base, -1, prime), prime, bits))

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        a, b = ((s[starts + size] + U(prime) - s[starts]) % U(prime) * back[starts] % U(prime) for s, back, (prime, _) in zip(self.sums, self.back, PRIMES, strict=True))
        return a << U(31) | b


def _room(free: np.ndarray) -> np.ndarray:
    """Free tokens from each place to the next marked one."""
    places = np.arange(len(free))
    return np.minimum.accumulate(np.where(free, len(free), places)[::-1])[::-1] - places


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first; of equals the first in the item, then in the document.

    The longest match of unmarked tokens has the greatest size at which both
    sides share a window: a bisection over running fingerprints, so that a
    size costs time in proportion to the tokens, however they repeat. All
    matches of that size are marked before the next size is sought.
    """
    tiles: list[tuple[int, int, int]] = []
    if min(len(item), len(doc)) < least:
        return tiles
    free_i, free_d, hash_i, hash_d = np.ones(len(item), bool), np.ones(len(doc), bool), Running(item), Running(doc)
    most = min(len(item), len(doc))
    while most >= least:
        room_i, room_d = _room(free_i), _room(free_d)

        def shared(size: int, room_i=room_i, room_d=room_d) -> tuple[np.ndarray, ...]:
            i, d = np.flatnonzero(room_i >= size), np.flatnonzero(room_d >= size)
            x, y = hash_i.at(i, size), hash_d.at(d, size)
            at, to = np.isin(x, y), np.isin(y, x)
            return i[at], x[at], d[to], y[to]

        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        starts, x, places, y = shared(low)
        order = np.argsort(y, kind="stable")
        y, places = y[order], places[order]
        left, end = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        next_place: dict[int, int] = {}
        for i, a, b in zip(starts.tolist(), left.tolist(), end.tolist(), strict=True):
            if not free_i[i] or not free_i[i + low - 1]:  # windows that were free are now marked at an end, if at all
                continue
            k = next_place.get(a, a)
            while k < b and not (free_d[places[k]] and free_d[places[k] + low - 1]):
                k += 1
            next_place[a] = k
            if k < b and (item[i : i + low] == doc[places[k] : places[k] + low]).all():
                free_i[i : i + low] = free_d[places[k] : places[k] + low] = False
                tiles.append((i, int(places[k]), low))
        most = low - 1
    return tiles


class SeedSet:
    """A sorted set of seeds behind a table of bits, most of which are clear."""

    BITS = 22

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.wanted >> U(64 - self.BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[hashes >> U(64 - self.BITS)])
        return at[np.isin(hashes[at], self.wanted)] if len(at) else at


def _item_seeds(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item, text in zip(batch["item_id"], batch["text"], strict=True):
            found = tokens(text)
            if len(found):
                size = min(least, len(found))
                yield pd.DataFrame({"seed": seeds(found, size).view(np.int64), "item_id": item, "at": np.arange(len(found) - size + 1, dtype=np.int32), "size": size, "n_tokens": len(found)})


def _item_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"item_id": batch["item_id"], "item": [tokens(t).tobytes() for t in batch["text"]]})


def _all_seeds(batches: Iterator[pd.DataFrame], sizes: list[int]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = tokens(text)
            hashes = np.unique(np.concatenate([seeds(found, size) for size in sizes]))
            yield pd.DataFrame({"seed": hashes.view(np.int64), "doc_id": doc})


def _passages(batches: Iterator[pd.DataFrame], sizes: list[int], shared=None) -> Iterator[pd.DataFrame]:
    """Documents with seeds: the distinct seeds, and the tokens that seeds cover with a mark after each passage."""
    common = SeedSet(shared.value) if shared is not None else None
    for batch in batches:
        rows = []
        for doc, text, own in zip(batch["doc_id"], batch["text"], batch["seeds"] if shared is None else [None] * len(batch), strict=True):
            found = tokens(text)
            cover, hit = np.zeros(len(found) + 1, np.int32), []
            for size in sizes:
                hashes = seeds(found, size)
                at = common.places(hashes) if common else np.flatnonzero(np.isin(hashes, np.asarray(own, np.int64).view(np.uint64)))
                if len(at):
                    hit.append(hashes[at])
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
            if hit:
                covered = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0])))).reshape(-1, 2)
                mark = mix(np.array([doc], np.int64).view(np.uint64) + U(1))
                parts = np.concatenate([x for a, b in edge.tolist() for x in (found[a:b], mark)])
                rows.append((doc, np.unique(np.concatenate(hit)).view(np.int64), parts.tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "seeds", "passages"])


def _tilings(batches: Iterator[pd.DataFrame], least: int, percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, item, parts, own in zip(batch["doc_id"], batch["item_id"], batch["passages"], batch["item"], strict=True):
            own, parts = np.frombuffer(own, np.uint64), np.frombuffer(parts, np.uint64)
            size = min(least, len(own))
            shared = np.flatnonzero(np.isin(seeds(own, size), seeds(parts, size)))
            cover = np.zeros(len(own) + 1, np.int32)
            np.add.at(cover, shared, 1)
            np.add.at(cover, shared + size, -1)
            if 100 * int((np.cumsum(cover) > 0).sum()) < percent * len(own):  # no tiling covers more than the shared seeds
                continue
            tiles = greedy_tiles(own, parts, size)
            matched = sum(n for *_, n in tiles)
            rows.append((doc, item, len(own), matched, len(tiles), max((n for *_, n in tiles), default=0), matched / len(own)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])


def _seeded(docs: DataFrame, found: DataFrame, broadcast_seeds: int) -> DataFrame:
    """doc_id, seeds and passages of documents that share a seed with an item."""
    distinct = written(found.select("seed").distinct(), "seeds")
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())  # least of them at most
    schema = "doc_id long, seeds array<long>, passages binary"
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    if distinct.count() <= broadcast_seeds:
        shared = np.array([r.seed for r in distinct.toLocalIterator()], np.int64).view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(shared)
        return texts.mapInPandas(functools.partial(_passages, sizes=sizes, shared=shared), schema)
    own = texts.mapInPandas(functools.partial(_all_seeds, sizes=sizes), "seed long, doc_id long").join(distinct, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    return texts.join(own, "doc_id").mapInPandas(functools.partial(_passages, sizes=sizes), schema)


def _one_item_each(items: DataFrame) -> DataFrame:
    """item_id and its distinct texts as one; a repeated row adds nothing."""
    held = items.where("item_id is not null and text is not null").groupBy("item_id")
    return held.agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))


def _one_document_each(seeded: DataFrame) -> DataFrame:
    """seeded with the seeds and passages of rows that share a doc_id put together."""
    together = F.aggregate(F.array_sort(F.collect_list("passages")), F.lit(b""), lambda s, x: F.concat(s, x))
    return seeded.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds"), together.alias("passages"))


def _rare_seeds(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """For each item the rarest seeds without which less than `percent` of it can be covered: a document that covers more has one of them."""
    for batch in batches:
        for item, n, size, found in zip(batch["item_id"], batch["n_tokens"], batch["size"], batch["found"], strict=True):
            cover, kept = np.zeros(n, bool), []
            # from the commonest on, seeds can be left out as long as they cover too little by themselves
            for row in sorted(found, key=lambda r: (-r["items"], r["seed"])):
                if not kept:
                    more = cover.copy()
                    for at in row["places"]:
                        more[at : at + size] = True
                    if 100 * int(more.sum()) < percent * n:
                        cover = more
                        continue
                kept.append(row["seed"])
            yield pd.DataFrame({"seed": np.array(kept, np.int64), "item_id": item})


def rare_seeds(found: DataFrame, percent: int) -> DataFrame:
    """seed and item_id of the seeds that candidates are joined on."""
    common = found.groupBy("seed", "item_id", "n_tokens", "size").agg(F.collect_list("at").alias("places"))
    items = common.groupBy("seed").agg(F.count("*").alias("items"))
    listed = common.join(items, "seed").groupBy("item_id", "n_tokens", "size").agg(F.collect_list(F.struct("seed", "items", "places")).alias("found"))
    return listed.mapInPandas(functools.partial(_rare_seeds, percent=percent), "seed long, item_id long")


def contamination(docs: DataFrame, items: DataFrame, least: int = LEAST, percent: int = COVERAGE_PERCENT, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """A row per document and item whose tiling covers at least `percent` of the item's tokens.

    Documents and items meet on rare seeds only: the commonest seeds of an item,
    as far as they cover less than `percent` of it, are left out of the join, so
    that a phrase common to many items does not pair them with every document
    that holds it. Tiles of all seeds count.
    """
    items = _one_item_each(items)
    found = written(items.mapInPandas(functools.partial(_item_seeds, least=least), "seed long, item_id long, at int, size int, n_tokens int"), "item-seeds")
    seeded = written(_one_document_each(_seeded(docs, found, broadcast_seeds)), "seeded")
    pairs = seeded.select("doc_id", F.explode("seeds").alias("seed")).join(rare_seeds(found, percent), "seed").select("doc_id", "item_id").distinct()
    loaded = pairs.join(seeded.select("doc_id", "passages"), "doc_id").join(items.mapInPandas(_item_tokens, "item_id long, item binary"), "item_id")
    tiled = loaded.mapInPandas(functools.partial(_tilings, least=least, percent=percent), REPORT)
    return tiled.where(F.col("n_matched") * 100 >= F.col("n_tokens") * percent)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark"))

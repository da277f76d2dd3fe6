"""Near-duplicate groups from SetSketch registers.

1. Every document's set of word shingles becomes a fingerprint and a sketch;
   documents with equal sets are one class from here on.
2. Bands of registers put classes into buckets.
3. Within buckets, sketches are compared by their joint likelihood; a pair
   that may reach the threshold is verified on the full sets.
4. Verified links merge groups. Pairs inside a group need no more work, so a
   family of any size costs links in proportion to its members. Early rounds
   verify each class's few likeliest candidates. The last round decides every
   candidate pair that is still across groups: tasks get the sets of those
   classes that have one and return the links that join groups, so that rows
   moved grow with classes and buckets, not with pairs.

Buckets over BLOCK classes are compared block by block, so that no task holds
a whole bucket; after the first round only classes outside the bucket's
largest group meet the others.

Null, empty and blank texts have no shingles and are linked with nothing. Rows
without doc_id are kept and linked with nothing. Rows that repeat a doc_id are
documents of their own: each is in the group of its text, and groups do not
merge because an id is in both.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.batches import batches_of, map_rows
from docquery.llm.components import components
from docquery.llm.sketch import REGISTERS, fingerprint, joint_jaccard, registers, shingles
from docquery.llm.storage import written

THRESHOLD_PERCENT = 80
#: Registers per band and bands; classes in a block; pairs compared at a time; candidates per class in each early round.
BAND, BANDS, BLOCK, PAIRS, ROUNDS = 4, 32, 512, 1 << 14, (2, 4)
#: Standard deviations of the estimate that a candidate may lie below the threshold.
MARGIN = 3.5
SKETCH = "doc_id long, n long, f1 long, f2 long, registers binary, text_hash long"
#: Sets of a task are handed over in so many rows, since a set may be large; a class with over 1/HOT of all rows is hot: there are HOT at most; ids below BELOW stand for repeated ones.
SET_ROWS, HOT, BELOW = 256, 1024, -(1 << 62)


def _sketches(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, text_hash in zip(batch["doc_id"], batch["text"], batch["text_hash"], strict=True):
            found = shingles((text or "").encode(), width)
            rows.append((doc, len(found), *fingerprint(found), registers(found).tobytes() if len(found) else None, text_hash))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SKETCH.split(", ")]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "elements": [shingles((t or "").encode(), width).tobytes() for t in batch["text"]]})


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows again, cut only between groups; they come sorted by keys and groups are bounded by BLOCK."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)
        cuts = np.flatnonzero(new)
        if held and (held[-1][keys].iloc[-1].to_numpy() != batch[keys].iloc[0].to_numpy()).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(cuts):
            yield pd.concat([*held, batch.iloc[: cuts[-1] + 1]], ignore_index=True)
            held = []
            batch = batch.iloc[cuts[-1] + 1 :]
        held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within neighbouring groups of the given sizes, in bounded lots."""
    starts = np.cumsum(sizes) - sizes
    left, right, lot = [], [], 0
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        for i in range(1, size):
            left.append(np.full(i, start + i))
            right.append(np.arange(start, start + i))
            lot += i
            if lot >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, lot = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def _likely_pairs(rows: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, estimate) of the pairs of neighbouring groups that are across labels and may reach the threshold, each in the first bucket that it shares."""
    t = percent / 100
    key = rows[["key", "part", "other"]].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
    doc, label, n = (rows[c].to_numpy(np.int64) for c in ("doc_id", "label", "n"))
    asks, band = rows["asks"].to_numpy(bool), rows["band"].to_numpy(np.int64)
    sketch = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), REGISTERS)
    for a, b in _pairs_of(np.diff(edge)):
        ok = (label[a] != label[b]) & (asks[a] | asks[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (doc[a] != doc[b])
        a, b = a[ok], b[ok]
        same = sketch[a] == sketch[b]
        once = same[:, : BAND * BANDS].reshape(-1, BANDS, BAND).all(axis=2).argmax(axis=1) == band[a]
        near = once & (same.sum(axis=1) >= (t - 2 * MARGIN * np.sqrt(t * (1 - t) / REGISTERS)) * REGISTERS)
        a, b = a[near], b[near]
        likely = joint_jaccard(sketch[a], sketch[b], n[a], n[b])
        good = likely >= t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)
        if good.any():
            yield a[good], b[good], likely[good]


def _candidates(batches: Iterator[pd.DataFrame], percent: int, most: int) -> Iterator[pd.DataFrame]:
    """For each class that asks its `most` likeliest candidates in a block."""
    for rows in _whole_groups(batches, ["key", "part", "other"]):
        doc, asks, key = rows["doc_id"].to_numpy(np.int64), rows["asks"].to_numpy(bool), rows["key"].to_numpy(np.int64)
        found = []
        for a, b, likely in _likely_pairs(rows, percent):
            u, v = np.maximum(doc[a], doc[b]), np.minimum(doc[a], doc[b])
            owner = np.where(asks[a] & asks[b], u, np.where(asks[a], doc[a], doc[b]))
            found.append(pd.DataFrame({"key": key[a], "owner": owner, "u": u, "v": v, "likely": likely}))
        if found:
            out = pd.concat(found, ignore_index=True).drop_duplicates(["key", "u", "v"]).sort_values(["key", "owner", "likely", "u", "v"], ascending=False)
            yield out[out.groupby(["key", "owner"]).cumcount() < most]


def _paired(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The rows that have a candidate in their block."""
    for rows in _whole_groups(batches, ["key", "part", "other"]):
        hit = np.zeros(len(rows), bool)
        for a, b, _ in _likely_pairs(rows, percent):
            hit[a] = hit[b] = True
        yield rows[hit]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _block_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links between labels that verified pairs of a block make; a pair whose labels are linked already is not looked at."""
    for rows in _whole_groups(batches, ["key", "part", "other"]):
        label, sets = rows["label"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in rows["elements"]]
        above: dict[int, int] = {}

        def root(x: int, above: dict[int, int] = above) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        links = []
        for a, b, likely in _likely_pairs(rows, percent):
            for i in np.argsort(-likely, kind="stable").tolist():
                p, q = root(int(label[a[i]])), root(int(label[b[i]]))
                if p != q and similar(sets[a[i]], sets[b[i]], percent):
                    above[max(p, q)] = min(p, q)
                    links.append((max(p, q), min(p, q)))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _verified(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        linked = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
        yield pd.DataFrame({"u": batch["u"], "v": batch["v"]})[np.array(linked, bool)]


def _buckets(reps: DataFrame) -> DataFrame:
    """key, doc_id, size of every bucket with more than one class."""
    slots = F.sequence(F.lit(0), F.lit(BANDS - 1))
    keys = F.transform(slots, lambda i: F.xxhash64(i, F.substring("registers", i * 2 * BAND + 1, F.lit(2 * BAND))))
    banded = reps.select("doc_id", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return written(banded.join(shared, "key"), "near-buckets")


def _contested(buckets: DataFrame, labels: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of those buckets of keys that hold several groups, with label, main (the bucket's largest group) and minor (rows outside it)."""
    labelled = buckets.select("key", "band", "size", "doc_id").join(labels, "doc_id")
    groups = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("main"), (F.sum("n") - F.max("n")).alias("minor"))
    return written(labelled.join(groups.where("minor > 0").join(keys.distinct(), "key", "left_semi"), "key"), "near-contested")


def _blocks(buckets: DataFrame, first: bool) -> DataFrame:
    """Adds part and other, the block pair that a row takes part in; asks: whether its pairs are of interest."""
    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    place = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), blocks(n))
    if first:
        return buckets.withColumns({"label": F.col("doc_id"), "part": place(F.col("size"), 0), "other": F.lit(0).cast("long"), "asks": F.lit(True)})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    settled = buckets.withColumn("part", every(F.col("minor"))).withColumn("other", place(F.col("size"), 1)).withColumn("asks", F.lit(False))
    asking = buckets.where("label <> main").withColumn("part", place(F.col("minor"), 0)).withColumn("other", every(F.col("size"))).withColumn("asks", F.lit(True))
    return settled.unionByName(asking)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one block pair together; each of the tasks holds many block pairs, one at a time."""
    return rows.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other")


def linked_groups(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id and label of the classes in groups of several; docs must hold the representatives' texts."""
    buckets = _buckets(reps)
    labels = written(buckets.select("doc_id").distinct().withColumn("label", F.col("doc_id")), "near-labels")
    members = buckets.select("doc_id").distinct().join(reps.select("doc_id", "first", "text_hash"), "doc_id").select(F.col("doc_id").alias("node"), F.col("first").alias("doc_id"), "text_hash")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(members, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    sets = written(own.select(F.col("node").alias("doc_id"), "text").mapInPandas(functools.partial(_sets, width=width), "doc_id long, elements binary"), "near-sets")
    merged = lambda links: written(labels.join(components(links).toDF("label", "to"), "label", "left").select("doc_id", F.coalesce("to", "label").alias("label")), "near-labels")
    sketched = lambda active, first: _blocks(active, first).select("key", "band", "part", "other", "doc_id", "label", "asks").join(reps.select("doc_id", "n", "registers"), "doc_id")
    active, again = buckets, None
    for i, most in enumerate(ROUNDS):
        if i:
            active = _contested(active, labels, again)
        found = written(_dealt(sketched(active, i == 0)).mapInPandas(functools.partial(_candidates, percent=percent, most=most), "key long, owner long, u long, v long, likely double"), "near-candidates")
        place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("likely"), "u", "v"))
        pairs = found.withColumn("place", place).where(F.col("place") <= most).select("u", "v").distinct()
        loaded = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
        with batches_of(docs.sparkSession, SET_ROWS):
            links = written(loaded.mapInPandas(functools.partial(_verified, percent=percent), "u long, v long"), "near-links")
        labels = merged(links.join(labels.toDF("u", "a"), "u").join(labels.toDF("v", "b"), "v").select("a", "b"))
        again = found.select("key").union(active.where(F.col("size") > BLOCK).select("key")) if i == 0 else found.select("key")
    rows = sketched(_contested(active, labels, again), False)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = written(_dealt(rows).mapInPandas(functools.partial(_paired, percent=percent), schema), "near-paired")
    links = _dealt(rows.join(sets, "doc_id")).mapInPandas(functools.partial(_block_links, percent=percent), "a long, b long")
    with batches_of(docs.sparkSession, SET_ROWS):
        links = written(links, "near-links")
    return merged(links)


def with_labels(sketches: DataFrame, groups: DataFrame) -> DataFrame:
    """sketches with the label of their class. Classes with over 1/HOT of all rows, of which there are HOT at most, are broadcast; empty sets have none."""
    keys, total = ["n", "f1", "f2"], sketches.count()
    hot = F.broadcast(groups.where(F.col("copies") * HOT > total).select(*keys, F.col("label").alias("hot")))
    marked = sketches.join(hot, keys, "left")
    alone = F.col("hot").isNotNull() | (F.col("n") == 0)
    rest = marked.where(~alone).join(groups.where(F.col("copies") * HOT <= total).select(*keys, "label"), keys, "left")
    return marked.where(alone).withColumn("label", F.col("hot")).unionByName(rest).drop("hot")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, text_hash."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketches = written(map_rows(texts, functools.partial(_sketches, width=width), SKETCH), "near-sketches")
    named = sketches.where("doc_id is not null and n > 0")
    least = F.min(F.struct("doc_id", "text_hash", "registers"))
    classes = named.groupBy("n", "f1", "f2").agg(least.alias("r"), F.count("*").alias("copies")).select("n", "f1", "f2", F.col("r.doc_id").alias("first"), "r.text_hash", "r.registers", "copies")
    classes = written(classes, "near-classes")
    # classes are known by their least doc_id, and where several have the same one by a hash far below all ids
    several = classes.groupBy("first").agg(F.count("*").alias("times")).where("times > 1")
    node = F.when(F.col("times").isNull(), F.col("first")).otherwise(BELOW - F.shiftrightunsigned(F.xxhash64("n", "f1", "f2"), 2))
    reps = written(classes.join(several, "first", "left").withColumn("doc_id", node).drop("times"), "near-classes")
    labels = linked_groups(docs, reps, width, percent)
    groups = reps.select("n", "f1", "f2", "copies", "first", "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named_so = groups.where(F.col("label") <= BELOW).groupBy("label").agg(F.min("first").alias("least"))
    groups = groups.join(named_so, "label", "left").select("n", "f1", "f2", "copies", F.coalesce("least", "label").alias("label"))
    out = with_labels(sketches.drop("registers"), groups)
    component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4).drop("text_hash")

"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees the text features
and the probabilities of the categories before it. In training those are
out-of-fold predictions, so that a later model meets the same kind of
probabilities as in use.

Features are the presence of lower-cased words and of their first 4, 5 and 6
bytes, hashed. The models are fitted on a bounded sample: SAMPLE labelled
documents with the least hashes of doc_id, whole texts, and the FEATURES most
associated with a category in it. Scoring covers every document in full.

Null and empty texts have no features. Rows of labels with a null are no
labels; rows that repeat a doc_id count once, with the greater label and the
least text. Without labelled documents nothing is flagged.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.batches import map_rows
from docquery.llm.decontamination import SeedSet
from docquery.llm.hashing import LOWER, PUNCTUATION, U, hashed, words
from docquery.llm.storage import written

#: Bound of the labelled sample and of the features; folds; least |z| of a feature; probability that flags.
SAMPLE, FEATURES, FOLDS, LEAST_Z, FLAG = 8192, 4096, 5, 5.0, 0.5
PREFIXES = (4, 5, 6)


def text_features(text: str | None) -> np.ndarray:
    """Hashes of the words and their prefixes, with repeats."""
    data = (text or "").encode()
    whole, starts, ends = words(data, lower=True, between=PUNCTUATION)
    if not len(whole):
        return whole
    low, parts = LOWER[np.frombuffer(data, np.uint8)], [whole]
    for size in PREFIXES:
        longer = ends - starts > size
        parts.append(hashed(low, starts[longer], starts[longer] + size) ^ U(size))
    return np.concatenate(parts)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "features": [np.unique(text_features(t)).view(np.int64) for t in batch["text"]]})


class Rows:
    """A sparse 0/1 matrix: for each entry its row and column."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, width: int):
        self.row, self.column, self.n, self.width = row, column, n, width

    def take(self, chosen: np.ndarray) -> Rows:
        at = np.full(self.n, -1)
        at[chosen] = np.arange(len(chosen))
        keep = at[self.row] >= 0
        return Rows(at[self.row[keep]], self.column[keep], len(chosen), self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Rows, chain: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam: weights of the features, of the chain's probabilities, and the intercept."""
    w = np.zeros(x.width + chain.shape[1] + 1)
    base = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(base / (1 - base))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        r = (sigmoid(x.dot(w[: x.width]) + chain @ w[x.width : -1] + w[-1]) - y) / max(len(y), 1)
        g = np.concatenate((x.back(r), chain.T @ r, [r.sum()]))
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[: x.width], w[x.width : -1], float(w[-1])


def fit_chain(x: Rows, y: np.ndarray, fold: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One model per category, in order; the chain's inputs are out-of-fold probabilities."""
    models, chain = [], np.zeros((x.n, 0))
    for k in range(y.shape[1]):
        out = np.zeros(x.n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                w, c, b = fit(x.take(inside), chain[inside], y[inside, k])
                out[outside] = sigmoid(x.take(outside).dot(w) + chain[outside] @ c + b)
        models.append(fit(x, chain, y[:, k]))
        chain = np.column_stack((chain, out))
    return models


def _fit(rows: pd.DataFrame, columns: np.ndarray) -> pd.DataFrame:
    rows = rows.sort_values("doc_id")
    own = [np.asarray(f, np.int64).view(np.uint64) for f in rows["features"]]
    row = np.repeat(np.arange(len(own)), [len(f) for f in own])
    column = np.searchsorted(columns, np.concatenate([*own, np.zeros(0, np.uint64)]))
    y = np.array(rows["y"].tolist(), float)
    models = fit_chain(Rows(row, column, len(rows), len(columns)), y, rows["fold"].to_numpy())
    return pd.DataFrame({"model": [pickle.dumps((columns, models))]})


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> bytes | None:
    """The chain for 0/1 label columns, in order; None without labelled documents."""
    named = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.array(*categories).alias("y"))
    # of texts that share a doc_id the least is fitted, so that reruns agree
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    seen = written(texts.mapInPandas(_features, "doc_id long, y array<double>, features array<long>"), "toxic-sample")
    totals = seen.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(len(categories))]).first()
    if not totals.n:
        return None
    counts = seen.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"p{k}") for k in range(len(categories))])
    z = F.lit(0.0)
    for k in range(len(categories)):
        p = totals[f"p{k}"] / totals.n
        if 0 < p < 1:
            z = F.greatest(z, F.abs((F.col(f"p{k}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))))
    best = written(counts.withColumn("z", z).where(f"n > 2 and z >= {LEAST_Z}").orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature"), "toxic-features")
    columns = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))  # FEATURES at most
    kept = seen.select("doc_id", "y", F.explode_outer("features").alias("feature")).join(F.broadcast(best.withColumn("known", F.col("feature"))), "feature", "left").groupBy("doc_id").agg(F.first("y").alias("y"), F.collect_set("known").alias("features"))
    rows = kept.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)))
    return bytes(rows.groupBy().applyInPandas(lambda x: _fit(x, columns), "model binary").first().model)


def _scores(batches: Iterator[pd.DataFrame], model, names: list[str]) -> Iterator[pd.DataFrame]:
    columns, models = pickle.loads(model.value)
    known = SeedSet(columns)
    for batch in batches:
        rows, cols = [], []
        for i, text in enumerate(batch["text"]):
            found = text_features(text)
            own = np.unique(found[known.places(found)]) if len(columns) else found[:0]
            rows.append(np.full(len(own), i))
            cols.append(np.searchsorted(columns, own))
        x = Rows(np.concatenate([*rows, np.zeros(0, int)]), np.concatenate([*cols, np.zeros(0, int)]), len(batch), len(columns))
        chain = np.zeros((len(batch), 0))
        for w, c, b in models:
            chain = np.column_stack((chain, sigmoid(x.dot(w) + chain @ c + b)))
        yield pd.DataFrame({"doc_id": batch["doc_id"], **{name: chain[:, k] for k, name in enumerate(names)}})


def scores(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), sample: int = SAMPLE) -> DataFrame:
    """doc_id and p_<category> of every row of docs, in the chain's order."""
    names = [f"p_{c}" for c in categories]
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names)
    model = train(docs, labels, categories, sample)
    if model is None:
        return docs.select("doc_id", *[F.lit(0.0).alias(n) for n in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs.select("doc_id", "text"), functools.partial(_scores, model=shared, names=names), schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The categories of the supplied labels: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents found toxic, with their probabilities."""
    return scores(docs, chain_labels(labels)).where(F.col("p_toxic") >= FLAG).withColumn("is_toxic", F.lit(True))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return flagged(read("documents"), read("labels"))

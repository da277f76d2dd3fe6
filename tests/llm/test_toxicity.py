import math
import pickle
import random

import numpy as np

from docquery.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    bad = ["vilest", "scumbag", "moron", "grimlyx"]
    junk = ["zzqx", "buynow", "clickbait"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic, low = int(rng.random() < 0.2), int(rng.random() < 0.2)
        for there, pool in ((toxic, bad), (low, junk)):
            for _ in range(there * rng.randrange(2, 5)):
                word = rng.choice(pool)
                words[rng.randrange(len(words))] = word + rng.choice(["", "s", "ery", ","])
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1 - low, toxic))
    return docs, labels


def test_held_out_accuracy_and_hard_rows(spark):
    docs, labels = corpus(1500)
    truth = {d: t for d, _, t in labels}
    hard = [(5000, None, "en"), (5001, "", "en"), (None, "moron vilest scumbag", "en"), (5002, "word1 " * 20_000 + "moron vilest", None)]
    df = spark.createDataFrame(docs + hard, "doc_id long, text string, toxic string")
    known = spark.createDataFrame([x for x in labels if x[0] < 900] + [(3, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(df, toxicity.chain_labels(known)).collect()
    assert len(rows) == len(docs) + len(hard)
    held = [(r.p_toxic >= 0.5, bool(truth[r.doc_id])) for r in rows if r.doc_id is not None and 900 <= r.doc_id < 1500]
    assert np.mean([a == b for a, b in held]) > 0.97
    found = {r.doc_id for r in toxicity.flagged(df, known).collect()}
    assert 5002 in found and None in found and not {5000, 5001} & found


def chain_weight(in_sample):
    """What the second model, whose category is the first one, gives to a first probability that only looks good in training."""
    rng = np.random.default_rng(2)
    n, width = 300, 4000
    y = (rng.random(n) < 0.5).astype(float)
    row, column = np.repeat(np.arange(n), 12), rng.integers(0, width, 12 * n)
    x = toxicity.Rows(row, column, n, width)
    if in_sample:
        w, c, b = toxicity.fit(x, np.zeros((n, 0)), y)
        chain = toxicity.sigmoid(x.dot(w) + b)[:, None]
        return toxicity.fit(x, chain, y)[1][0]
    return toxicity.fit_chain(x, np.column_stack((y, y)), np.arange(n) % toxicity.FOLDS)[1][1][0]


def test_later_models_see_out_of_fold_probabilities():
    """Features are noise: out of fold they foretell nothing, while in-sample probabilities repeat the labels."""
    assert chain_weight(in_sample=False) < 0.5 < 2 < chain_weight(in_sample=True)


def test_scores_match_a_plain_version(spark):
    docs, labels = corpus(300, seed=3)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    known = toxicity.chain_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns, models = pickle.loads(toxicity.train(df, known, ("low_quality", "toxic")))
    places = {h: i for i, h in enumerate(columns.tolist())}
    want = {}
    for d, text, _ in docs:
        held = {places[h] for h in toxicity.text_features(text).tolist() if h in places}
        chain = []
        for w, c, b in models:
            chain.append(1 / (1 + math.exp(-(sum(w[i] for i in held) + sum(p * q for p, q in zip(chain, c, strict=True)) + b))))
        want[d] = chain
    for r in toxicity.scores(df, known).collect():
        assert np.allclose((r.p_low_quality, r.p_toxic), want[r.doc_id])


def test_texts_that_share_an_id_are_fitted_alike(spark):
    docs, labels = corpus(60, seed=4)
    twice = docs + [(d, "zz " + t, x) for d, t, x in docs]
    known = toxicity.chain_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    models = [toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(n), known, ("toxic",)) for rows, n in ((twice, 2), (twice[::-1], 5))]
    assert models[0] == models[1]


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.flagged(df, none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.flagged(df, one).count() == 0
    assert toxicity.flagged(df.where("false"), one).count() == 0

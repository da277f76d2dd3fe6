import random
import re
from itertools import combinations

import numpy as np
import pytest

from docquery.llm import near_dedup
from docquery.llm.sketch import joint_jaccard, registers, shingles


def word_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [(d, word_sets(t, width)) for d, t in rows]
    label = {d: d for d, _ in rows}
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(s), label[d], label[d] == d) for d, s in sets}


def corpus(seed, families=12, members=25):
    rng = random.Random(seed)
    line = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    rows, at = [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "one two"), (90_005, "ONE two"), (90_006, "one three")], 0
    for _ in range(families):
        base = line(rng.randrange(5, 200))
        for _ in range(rng.randrange(1, members)):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                new[rng.randrange(len(new))] = rng.choice(line(1))
            rows.append((at, " ".join(new).upper() if rng.random() < 0.1 else " ".join(new)))
            at += rng.randrange(1, 4)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 6)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(df, 4).drop("text_hash").collect()}
    assert got == brute(rows, 4)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df).drop("text_hash").collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_rows_that_repeat_a_doc_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (1, c), (1, c + " more"), (2, a + " more"), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[::2] for r in near_dedup.near_duplicates(df, 4).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(0, 0), (1, 0), (1, 1), (1, 1), (1, 1), (2, 1), (5, 1)]


def test_thue_morse_words_differ(spark):
    one, other = ["a"], ["b"]
    for _ in range(10):
        one, other = one + other, other + one
    tail = " ".join(f"w{i}" for i in range(3))
    df = spark.createDataFrame([(1, "".join(one) + " " + tail), (2, "".join(other) + " " + tail)], "doc_id long, text string")
    assert [r.component_id for r in near_dedup.near_duplicates(df, 4).orderBy("doc_id").collect()] == [1, 2]


def test_unlinked_family_and_hot_copies(spark, monkeypatch):
    """A family of near copies below the threshold, with few links, and copies of one text; small blocks and hot classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(1000 + i, " ".join(base)) for i in range(40)]
    for i in range(1, 60):
        new = list(base)
        for j in rng.sample(range(100), rng.choice([4, 7, 8])):
            new[j] = f"x{i}.{j}"
        rows.append((i, " ".join(new)))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).drop("text_hash").collect()}
    assert got == brute(rows, 4)


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    errors = []
    for size, share in [(60, 0.8), (400, 0.8), (2000, 0.5), (2000, 0.9)]:
        for _ in range(40):
            pool = rng.integers(1, 1 << 64, size, dtype=np.uint64)
            cut = int(size * (1 + share) / 2)
            a, b = pool[:cut], pool[size - cut :]
            true = len(np.intersect1d(a, b)) / size
            errors.append(joint_jaccard(registers(a)[None], registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_sketches_merge():
    a, b = shingles(b"a b c d e f g", 2), shingles(b"x y z a b c q", 2)
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()

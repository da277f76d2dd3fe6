import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docquery.llm.fm_index import BidirectionalIndex, rotations
from docquery.llm.spelling import near_words, op11_spelling_variants, spoilt_words, variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words, ratio=2):
    out, forms = {}, {}
    for w, n in words.items():
        found = sorted((-m, x) for x, m in words.items() if near(w, x))
        form = found[0] if found and -found[0][0] >= ratio * n else None
        forms[w] = form and form[1]
        out[w] = (n, len(found), form and -form[0])
    rows = set()
    for w, (n, many, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, many, m))
    return rows


def frame(spark, words):
    return spark.createDataFrame(list(words), "word string, n long")


def columns(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def made(seed, letters, longest, many):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 2, 4, 4, 9, 40]) for _ in range(many)}


def test_rotations_are_sorted():
    text = np.array([2, 1, 2, 1, 0, 2, 1, 0])
    order = rotations(text)
    turned = [np.roll(text, -i).tolist() for i in order]
    assert turned == sorted(turned) and sorted(order) == list(range(8))


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aÿ\U0001f600"])
def test_index_finds_each_pair_once(letters):
    for seed in range(12):
        words = sorted(made(seed, letters, 7, 50))
        half = np.array([len(w) // 2 for w in words])
        found = list(zip(*(x.tolist() for x in BidirectionalIndex(words).one_error(words, half)), strict=True))
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and b.startswith(a[: half[i]])}
        assert len(found) == len(set(found)) and set(found) == want


def test_patterns_that_are_not_indexed():
    index = BidirectionalIndex(["later", "water"])
    q, w = index.one_error(["lager", "zzzzz", "lazer"], np.array([2, 2, 2]))
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(0, 0), (2, 0)]


@pytest.mark.parametrize("block_letters", [64, 4000, 1 << 18])
def test_variants_match_every_pair(spark, block_letters):
    words = made(5, "abc", 9, 700)
    assert set(columns(variants(frame(spark, words.items()), block_letters=block_letters))) == brute(words)


def test_one_half_that_most_words_share_is_split(spark):
    r = random.Random(8)
    words = {"gemeinsam" + "".join(r.choice("abcd") for _ in range(r.randint(4, 9))): r.choice([3, 7, 30]) for _ in range(500)}
    words |= {w[::-1]: n for w, n in list(words.items())[:200]} | made(2, "abcd", 8, 200)
    assert set(columns(variants(frame(spark, words.items()), block_letters=600))) == brute(words)


def test_long_words_ties_and_chains(spark):
    long = "ab" * 3000
    words = {long: 9, long[:-1]: 3, long[:2000] + "x" + long[2000:]: 4, "steps": 100, "stepz": 50, "stezz": 25, "sbezz": 12, "stops": 100, "slops": 100, "lone!": 1}
    found = columns(variants(frame(spark, words.items())))
    assert set(found) == brute(words)
    assert ("sbezz", "stezz", "steps", 12, 1, 25) in found


def test_nulls_repeats_empty_words_and_tables(spark):
    rows = frame(spark, [("apple", 2), ("apple", 3), ("appel", 5), ("apples", 1), (None, 4), ("", 9), ("a", 8), ("maple", 0), ("apply", None)])
    assert set(columns(variants(rows))) == brute({"apple": 5, "appel": 5, "apples": 1, "a": 8})
    assert variants(frame(spark, [])).collect() == [] and near_words(frame(spark, [("alone", 3)])).collect() == []


def spoilt(docs, runs):
    count = Counter()
    for doc, text in docs:
        for run in runs(text or ""):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 97 == 0 else run
            count[word] += len(word) >= 5
    return {(w, n) for w, n in count.items() if n >= 3}


def test_words_of_texts(spark):
    import re

    letters = "abcdeÀéß×÷ÿZ"
    r = random.Random(4)
    docs = [(i if i % 7 else None, " ".join(r.choice(["", "-", "1"]) + "".join(r.choice(letters) for _ in range(r.choice([2, 3, 5, 5, 6]))) for _ in range(1500)) + " Straße" * 40 + "Āword" * 3) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "x" * 300_000), (93, "x" * 300_000), (94, "x" * 300_000)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, h long, word string")
    want = spoilt(docs, lambda t: re.findall("[A-Za-zÀ-ÿ]+", t.translate(lower)))
    assert {tuple(x) for x in spoilt_words(rows).collect()} == want and any(len(w) == 300_000 for w, _ in want)


def test_query_columns(spark, sf):
    found = op11_spelling_variants(spark, sf)
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}

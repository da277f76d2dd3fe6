import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from docquery.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = [rng.choice(["ab", "cé", "d", "eee", "f"]) + str(rng.randrange(9)) for _ in range(40)]
    line = lambda k: " ".join(rng.choice(letters) for _ in range(k))
    shared = [line(rng.randrange(10, 90)) for _ in range(6)]
    rows = [(1000, None, "en"), (1001, "", "en"), (1002, "a " * 700, None), (1003, "x" * 900, "en"), (1004, " \t\n", "en")]
    for i in range(n):
        parts = [line(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), line(rng.randrange(0, 30))]
        rows.append((rng.randrange(10_000), " ".join(parts), "en"))
    whole = rows[-1][1]
    rows += [(20_000 + i, whole, "en") for i in range(12)] + [(30_000, whole + " end", "de"), (30_001, "begin " + whole, "de")]
    return list({r[0]: r for r in rows}.values())


def brute_bytes(rows, length):
    at = defaultdict(list)
    data = {d: (t or "").encode() for d, t, *_ in rows}
    for d, b in data.items():
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((d, i))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    out = {}
    for d, b in data.items():
        spans = sum(i - 1 not in gone[d] for i in gone[d])
        out[d] = (len(b), len(gone[d]), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone[d])).hexdigest())
    return out


def brute_words(rows, length):
    seen, gone, words = set(), defaultdict(set), {}
    for d, t, *_ in sorted(rows):
        words[d] = (t or "").encode().split()
        for i in range(len(words[d]) - length + 1):
            key = tuple(words[d][i : i + length])
            if key in seen:
                gone[d].update(range(i, i + length))
            seen.add(key)
    return {d: (len(w), len(gone[d]), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone[d])).hexdigest()) for d, w in words.items()}


@pytest.mark.parametrize(("seed", "length", "anchor"), [(1, 400, 256), (2, 100, 64), (3, 60, 8)])
def test_bytes_match_brute_force(spark, seed, length, anchor):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_digests(df, length, anchor).collect()}
    assert got == brute_bytes(rows, length)


@pytest.mark.parametrize(("seed", "length", "kgram"), [(4, 20, 8), (5, 6, 2), (6, 12, 12)])
def test_words_match_brute_force(spark, seed, length, kgram):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_digests(df, length, kgram).collect()}
    assert got == brute_words(rows, length)


def test_pieces_of_long_texts_agree(monkeypatch):
    rule = suffix_dedup.byte_rule(50, 16)
    text = "".join(random.Random(7).choice("abc") for _ in range(5000))
    ranks = rule.ranks(text)
    cover = lambda: sorted((int(a), int(a + n)) for _, _, at, ns in repeats.document_runs(ranks, rule) for a, n in zip(at, ns, strict=True))
    whole = cover()
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = cover()
    assert whole[0][0] == parts[0][0] == 0 and whole[-1][1] == parts[-1][1] == 4951
    assert Counter(i for a, b in parts for i in range(a, b)) == Counter(range(4951))


def test_ranked_windows_come_in_bounded_frames(monkeypatch):
    rule = suffix_dedup.byte_rule(50, 16)
    rows = [(i, 0, "".join(random.Random(i).choice("ab") for _ in range(900)), [{"at": 0, "n": 300, "sure": False}, {"at": 700, "n": 150, "sure": True}, {"at": 800, "n": 99, "sure": True}]) for i in range(7)]
    batch = pd.DataFrame(rows, columns=["doc_id", "row", "text", "asked"])
    whole = pd.concat(list(repeats.rank_windows(iter([batch]), rule)))
    monkeypatch.setattr(repeats, "TOGETHER", 400)
    parts = list(repeats.rank_windows(iter([batch.iloc[:3], batch.iloc[3:]]), rule))
    assert len(parts) > 4 and max(map(len, parts)) <= 700 and len(whole) == 7 * 450
    assert pd.concat(parts).reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_repeated_rows_and_texts(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    words = sorted(map(tuple, substring_dedup.dedup_digests(df).collect()), key=str)
    assert [(r[0], r[2]) for r in words] == [(1, 0), (1, 0), (2, 80), (None, 0)]
    kept = {(r.doc_id, r.text) for r in substring_dedup.dedup_texts(df).collect()}
    assert kept == {(1, text), (2, ""), (None, text)}
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_digests(df, 100, 64).collect()}
    assert removed == {1: len(text), 2: len(text), None: len(text)}
    assert {r.n_removed for r in suffix_dedup.dedup_digests(df.where("doc_id is null or doc_id = 2"), 100, 64).collect()} == {len(text)}
    assert {r.text for r in suffix_dedup.dedup_texts(df.where("doc_id = 2"), 100, 64).collect()} == {text}


def test_texts_under_one_id_are_told_apart(spark):
    """A text that occurs once stays, whatever happens to another text under its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, b + " " + c), (3, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.dedup_texts(once).collect()) == [(1, ""), (1, b), (2, "")]
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.dedup_texts(df).collect()) == [(1, ""), (1, ""), (2, ""), (2, " "), (3, "")]
    first = spark.createDataFrame([(2, a), (2, b), (1, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in substring_dedup.dedup_texts(first).collect()) == [(1, a), (2, ""), (2, b)]
    assert sorted((r.doc_id, r.text) for r in substring_dedup.dedup_texts(df).collect()) == [(1, a), (1, b), (2, ""), (2, c), (3, "")]
    inside = spark.createDataFrame([(1, a), (1, a + " " + b)], "doc_id long, text string")
    kept = sorted(r.text for r in substring_dedup.dedup_texts(inside).collect())
    assert kept in ([a, b], ["", a + " " + b])


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_thue_morse_sequences_differ(spark):
    """Sequences that polynomials modulo a power of two cannot tell apart: as words, of words, of bytes."""
    one, other = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    tail = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([other, *tail]))]
    rows += [(3, " ".join(thue_morse(1024, "x", "y"))), (4, " ".join(thue_morse(1024, "y", "x"))), (5, one + one), (6, other + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup_digests(df).collect()}
    assert got == brute_words(rows, 20) and got[2][1] == 0
    for length, anchor in ((400, 256), (64, 16)):
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup_digests(df, length, anchor).collect()} == brute_bytes(rows, length)


def test_large_ids_beside_null(spark):
    df = spark.createDataFrame([(2**60 + 1, "a b"), (None, "c"), (2**60 + 3, None)], "doc_id long, text string").coalesce(1)
    for out in (substring_dedup.dedup_digests(df), suffix_dedup.dedup_digests(df)):
        assert {r.doc_id for r in out.collect()} == {2**60 + 1, None, 2**60 + 3}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_digests(df).count() == substring_dedup.dedup_digests(df).count() == 0

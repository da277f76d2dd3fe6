import random
import re
import time
from itertools import product

import numpy as np
import pytest

from docquery.llm.decontamination import LEAST, contamination, greedy_tiles

ITEM = " ".join(f"q{i}" for i in range(30))


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: mark the longest matches first."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i, j in product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            if n > best or n == best and not found:
                best, found = n, [(i, j)]
            elif n == best:
                found.append((i, j))
        if not found:
            return sorted(total, reverse=True)
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                total.append(best)


@pytest.mark.parametrize("seed", range(30))
def test_tiles_match_the_definition(seed):
    rng = random.Random(seed)
    a = [rng.randrange(12) for _ in range(rng.randrange(1, 40))]
    cuts = sorted(rng.sample(range(len(a) + 1), min(3, len(a))))
    parts = [a[i:j] for i, j in zip([0, *cuts], [*cuts, len(a)], strict=True)]
    rng.shuffle(parts)
    b = [x for p in parts for x in [*p, *[rng.randrange(12) for _ in range(rng.randrange(4))]]]
    tiles = greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
    assert sorted((n for *_, n in tiles), reverse=True) == brute_tiles(a, b, 3)


@pytest.mark.parametrize(("n", "m", "period"), [(3000, 3000, 1), (1200, 2400, 3), (3000, 20_000, 7)])
def test_repetitive_texts_take_bounded_time(n, m, period):
    began = time.time()
    tiles = greedy_tiles(np.arange(n, dtype=np.uint64) % period, np.arange(m, dtype=np.uint64) % period, LEAST)
    assert sum(size for *_, size in tiles) == n and time.time() - began < 2


def test_the_operator_matches_brute_force(spark):
    rng = random.Random(6)
    common = "one phrase that many items share"
    texts = [" ".join([common, *[f"q{i}.{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))], common]) for i in range(12)] + [common, "p " * 9, "two words"]
    docs = []
    for i in range(80):
        parts = [" ".join(f"n{rng.randrange(500)}" for _ in range(rng.randrange(20)))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(texts).split()
            cut = rng.randrange(len(own))
            parts += [" ".join(own[cut:]), rng.choice(["", "and", common]), " ".join(own[: rng.choice([cut, len(own)])])]
        docs.append((i, " ".join(parts)))
    want = {}
    found = lambda t: re.findall(r"[A-Za-z0-9]+", t.lower())
    for (d, text), (i, item) in product(docs, enumerate(texts)):
        own, least = found(item), min(LEAST, len(found(item)))
        tiles = brute_tiles(own, found(text), least)
        if 100 * sum(tiles) >= 60 * len(own):
            want[d, i] = (len(own), sum(tiles))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_matched) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) <= LEAST for x in want), [(got[x], want[x]) for x in want if got[x] != want[x]]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_reordered_edited_and_clean(spark, limit):
    words = ITEM.split()
    rows = [
        (1, "before " + ITEM + " after"),
        (2, " ".join(["x", *words[20:], "y", *words[10:20], "z", *words[:10]])),
        (3, ITEM.upper().replace(" ", ", ") + "!"),
        (4, " ".join(words[:12])),
        (5, " ".join(f"c{i}" for i in range(60))),
        (6, None),
        (7, ""),
        (8, "says tiny thing here"),
        (None, ITEM),
    ]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, "Tiny thing"), (12, ""), (13, None), (None, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.coverage) for r in contamination(docs, items, broadcast_seeds=limit).collect()}
    assert got == {(1, 10): (1, 1.0), (2, 10): (3, 1.0), (3, 10): (1, 1.0), (8, 11): (1, 1.0)}
    assert contamination(docs.where("false"), items, broadcast_seeds=limit).count() == 0
    assert contamination(docs, items.where("false"), broadcast_seeds=limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_that_share_an_id_are_put_together(spark, limit):
    words = ITEM.split()
    other = " ".join(f"p{i}" for i in range(30))
    rows = [(1, " ".join(words[:11])), (1, " ".join(words[11:22])), (2, ITEM), (2, "again " + ITEM), (3, " ".join(words[:11])), (4, other), (5, other + " x " + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (20, ITEM), (20, other)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tokens, r.n_matched) for r in contamination(docs, items, broadcast_seeds=limit).collect())
    assert got == [(1, 10, 30, 22), (2, 10, 30, 30), (5, 10, 30, 30), (5, 20, 60, 60)]

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from docquery.llm.mixing import label_quality, mixed
from docquery.llm.sharding import kd_shards, sharded

DOCS = "doc_id long, text string, lang string, source string, size string, key string"


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    rows = [(i, "wörd " * int(rng.expovariate(1 / 60)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "c", "d", None]), "x", "y") for i in range(n)]
    rows += [(n + i, "copied words here " * 30, "en", "hot", None, None) for i in range(n // 2)]
    return [*rows, (5000, None, None, None, None, None), (5001, "", "en", "a", None, None), (None, "t", "en", "a", None, None), (3, "again", "en", "b", None, None)]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_near_equal_and_gapless(spark, monkeypatch, shards):
    monkeypatch.setattr("docquery.llm.sharding.NUMBERED", 10)
    rows = corpus()
    out = sharded(spark.createDataFrame(rows, DOCS).repartition(3), shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    held, slots = Counter(), defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean, largest = sum(held.values()) / shards, max(r["size"] for r in out)
    assert all(abs(held[s] - mean) <= 2 * largest for s in range(shards))


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i} " * rng.randrange(1, 40), "en", rng.choice("abc")) for i in range(3000)]
    groups = [f"copied {g} " * rng.randrange(1, 30) for g in range(60)]
    rows += [(5000 + i, rng.choice(groups), rng.choice(["en", "de"]), rng.choice("abc")) for i in range(900)]
    rows += [(9000 + i, "hot text " * 20, None, "d") for i in range(1500)]  # over a whole shard
    out = sharded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=12).collect()
    held, shards = Counter(), defaultdict(set)
    text = {d: t for d, t, *_ in rows}
    for r in out:
        held[r.shard] += r["size"]
        shards[text[r.doc_id]].add(r.shard)
    mean = sum(held.values()) / 12
    assert len(out) == len(rows) and all(abs(held[s] - mean) < 0.02 * mean for s in range(12))
    assert {t for t, s in shards.items() if len(s) > 1} == {"hot text " * 20}
    again = {(r.doc_id, r.shard) for r in sharded(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string").repartition(7), shards=12).collect()}
    assert again == {(r.doc_id, r.shard) for r in out}


def test_tree_splits_along_the_widest_dimension(spark):
    """Against a k-d tree by sorting, on points whose codes do not tie."""
    rng = random.Random(1)
    points = [(i, rng.randrange(10, 60), x, y) for i, (x, y) in enumerate(zip(rng.sample(range(60_000), 600), rng.sample(range(9_000), 600), strict=True))]
    df = spark.createDataFrame([(i, s, x, y, i % 7, i) for i, s, x, y in points], "id long, size long, x long, y long, d1 long, d2 long")
    got = {r.id: r.shard for r in kd_shards(df, ["x", "y"], [1.0] * 6).collect()}
    width, want = [max(p[k] for p in points) - min(p[k] for p in points) for k in (2, 3)], {}

    def split(own, lo, n):
        if n == 1:
            want.update({p[0]: lo for p in own})
            return
        dim = max((2, 3), key=lambda k: (max(p[k] for p in own) - min(p[k] for p in own)) / width[k - 2])
        own, goal, upto, cut = sorted(own, key=lambda p: p[dim]), sum(p[1] for p in own) * (n // 2) // n, 0, 0
        while upto + own[cut][1] < goal:
            upto, cut = upto + own[cut][1], cut + 1
        cut += upto + own[cut][1] - goal <= goal - upto
        split(own[:cut], lo, n // 2)
        split(own[cut:], lo + n // 2, n - n // 2)

    split(points, 0, 6)
    assert got == want


def test_shards_by_target_and_of_nothing(spark):
    df = spark.createDataFrame(corpus(200), DOCS)
    total = df.select(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0]
    assert sharded(df, target_bytes=total // 5 + 1).agg(F.max("shard")).first()[0] == 4
    assert sharded(df.where("false"), shards=4).count() == 0


def brute_mix(rows, quality):
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(sources)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * size[s]]
        for s in over or list(open_):
            target[s] = 2 * size[s] if over else share * weight[s]
            left -= target[s]
            open_.discard(s)
    out = []
    for s in sources:
        own = []
        for d, t, x in rows:
            if x == s:
                u = (int(md5(f"mix-1:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / quality.get(d, 1.0), -1 if d is None else d, len((t or "").split()), d))
        epochs = target[s] // size[s] if size[s] else 0
        rest, before = target[s] - epochs * size[s], 0
        for _, _, n, d in sorted(own, key=lambda x: x[:3]):
            out.append((d, n, size[s], round(target[s], 6), n * int(min(2, epochs + (before + n / 2 <= rest)))))
            before += n
    return out


@pytest.mark.parametrize("range_rows", [20, 20_000])
def test_mixing_matches_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr("docquery.llm.mixing.RANGE_ROWS", range_rows)
    rows = corpus()
    labels = [(i, i % 2, 0) for i in range(0, 300, 3)] + [(0, None, 0), (None, 1, 0), (6, 1, 1)]
    quality = {}
    for d, q, _ in labels:
        if d is not None and q is not None:
            quality[d] = max(quality.get(d, 0), 2.0 if q else 0.5)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = mixed(df, label_quality(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in out.collect()]
    assert Counter(got) == Counter(brute_mix([(d, t, s) for d, t, _, s, *_ in rows], quality))
    sums = defaultdict(int)
    for _, _, source, aim, taken in got:
        sums[source, aim] += taken
    assert all(abs(n - aim) <= 0.05 * aim + 60 for (_, aim), n in sums.items())


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    labels = label_quality(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert mixed(df, labels).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, None, None)], DOCS)
    assert [tuple(r) for r in mixed(blank, labels).collect()] == [(1, 0, 0, 0.0, 0)]


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([], DOCS)
    labels = label_quality(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for out in (sharded(df, shards=3), mixed(df, labels)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

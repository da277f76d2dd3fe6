import random
from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquery.llm.mixing import label_quality, mixed
from docquery.llm.queries import ORACLES, QUERIES


def test_stages_take_effect(spark):
    rows = [(i, " ".join(f"w{(i * 37 + j * (i + 3)) % 5003}" for j in range(60)), "en", f"src{i % 3}", 0) for i in range(80)]
    rows += [(100, rows[0][1] + " more", "en", "src0", 0), (101, "leaked " + " ".join(f"q{j}" for j in range(20)), "en", "src1", 0), (102, None, None, None, None), (103, "", "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_dedup"](spark, docs, "")
    assert near.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in near.collect()} == {100}
    shards = stages["sharding"](spark, near, "").collect()
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in near.collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, times int, id long, hot string, row string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that stages use inside."""
    return spark.createDataFrame([(d, t, "en", s, 0, "c", 7, 8, "h", "r") for d, t, s in rows], DOCS)


def test_toxicity_stage(spark, tmp_path):
    rng = random.Random(1)
    line = lambda k: " ".join(f"word{rng.randrange(300)}" for _ in range(k))
    rows = [(i, line(40) + (" scumbag vilest" if i % 4 == 0 else ""), "a") for i in range(600)]
    rows += [(1000, line(30) + " scumbag and vilest", "a"), (1001, line(50), "a"), (1002, None, "a"), (1003, "", "a"), (None, "scumbag vilest scumbag", "a")]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    left = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, *_ in rows if d is None or not (d % 4 == 0 and d < 600 or d == 1000)}


def test_texts_under_one_id_have_verdicts_of_their_own(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x " + item, "s"), (1, "clean text of its own", "s"), (1, "clean text of its own", "t"), (2, None, "s"), (2, item, "s")]
    left = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r.doc_id, r.text, r.source, r.row) for r in left.collect()), key=str) == [(1, "clean text of its own", "s", "r"), (1, "clean text of its own", "t", "r"), (2, None, "s", "r")]


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_near_dedup_stage(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, a + " more", "s"), (4, None, "s"), (5, None, "s"), (None, a, "s"), (6, "", "s"), (7, b, "s")]
    left = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert left.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (4, None), (5, None), (None, a), (6, "")], key=str)


def test_decontamination_stage(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x " + item + " y", "s"), (2, " ".join([*item.split()[10:], "z", *item.split()[:10]]), "s"), (3, "q1 q2 q3 q4", "s"), (4, None, "s"), (None, item, "s")]
    left = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {3, 4, None}


def test_mixing_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"w{i} " * (1 + i % 9), f"s{i % 3}") for i in range(300)] + [(7, "w7 " * 8, "s1"), (7, "other text", "s1"), (None, "no id", "s0"), (None, "no id", "s0"), (400, None, "s0"), (401, "", None)]
    docs = frame(spark, rows)
    out = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed(docs, label_quality(spark.read.parquet(f"{tmp_path}/labels.parquet")), row=F.struct("doc_id", "text", "source")).collect():
        want[tuple(r.row)] += r.taken // r["size"] if r.taken else 0
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n}) and max(got.values()) >= 2


def test_sharding_stage(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 4000)
    out = corpus_pipeline.sharding(spark, frame(spark, [(i // 2, f"text {i // 2} " * 9, "s") for i in range(200)]), "").collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert len(out) == 200 and len(sizes) == -(-sum(sizes.values()) // 4000) and max(sizes.values()) < 1.1 * 4000


def test_run_over_the_small_tables(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    extra, lacking = compare.differences(spark, compare.connect(sf), QUERIES[name], ORACLES[name], sf)
    assert not extra and not lacking

import pytest

from docquery.operators.answering import hydrated, hydrated_by_id
from docquery.sources.buckets import Buckets


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(1, 2001).selectExpr("id as chunk_db_id", "id % 3 + 1 as workspace_id", "concat('c', id) as chunk_id", "concat('text ', id) as text")
    return rows, Buckets.fresh(spark, "chunks", "chunk_db_id", 16).write(rows)


def test_only_the_hits_move(spark, table):
    rows, held = table
    hits = spark.range(500).selectExpr("id as query_id", "if(id % 5 = 0, 9, (id * 7 + 1) % 3 + 1) as workspace_id", "id * 7 + 1 as point_id", "0.5D as score", "1 as rank")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hydrated_by_id(hits, held.read())
        text = plan(found)
        stored = text[text.index("chunk_db_id#") :]
        assert text.split("Initial Plan")[0].count("Exchange") == 1 and "Bucketed: true" in stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = hydrated(hits, rows)
    names = sorted(want.columns)
    assert sorted(found.columns) == names and sorted(found.select(names).collect()) == sorted(want.select(names).collect()) and found.count() > 50


def test_lookups_read_the_buckets_of_their_keys(spark, table):
    rows, held = table
    assert sorted(r.chunk_id for r in held.of([3, 1999, 5000]).collect()) == ["c1999", "c3"]
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(name, "false")  # else the plan prunes as well, but does not say so
    try:
        text = plan(held.of([3]))
    finally:
        spark.conf.unset(name)
    assert "SelectedBucketsCount: 1 out of 16" in text and "PushedFilters" in text


def test_writing_replaces_and_empty_tables(spark, table):
    rows, _ = table
    held = Buckets.fresh(spark, "others", "chunk_db_id", 4).write(rows.where("chunk_db_id < 10"))
    held.write(rows.where("chunk_db_id < 0"))
    assert held.read().count() == 0 and held.of([1]).collect() == []
    with pytest.raises(ValueError, match="positive"):
        Buckets(spark, "x", "id", 0)

import pytest

from docquery.operators.numbering import numbered, read_lines
from docquery.sources import store as stores
from docquery.sources.files import read_files
from docquery.sources.store import Store, Table, upsert_together
from docquery.streaming.ingestion import ingest_stream, with_document_ids

DOCUMENTS = "file_key string, document_id long, workspace_id long, filename string, status string, error_message string, created_at timestamp, updated_at timestamp"


def test_numbers_have_no_gaps_over_many_partitions(spark):
    rows = spark.range(20_000).selectExpr("cast(hash(id) % 5000 as long) as a", "id as b").repartition(13)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = numbered(rows, ["a", "b"], "n", 7)
        assert found.select("n").distinct().count() == 20_000
        parts = {r[0] for r in numbered(rows, ["a", "b"]).selectExpr("number").collect()}
        assert parts == set(range(1, 20_001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = sorted((r.n, r.a, r.b) for r in found.collect())
    assert [(a, b) for _, a, b in got] == sorted((a, b) for _, a, b in got) and [n for n, *_ in got] == list(range(7, 20_007))


def test_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "a int, v string")
    assert sorted((r.number, r.a) for r in numbered(rows, ["a"]).collect()) == [(1, None), (2, 1), (3, 1)]
    assert numbered(rows.where("a > 9"), ["a"]).collect() == []
    with pytest.raises(ValueError, match="column a"):
        numbered(rows, ["a"], "a")


def test_lines_of_files_that_are_read_in_many_splits(spark, tmp_path):
    text = "".join(f"line {i}" + " x" * (i % 9) + ["\n", "\r\n", "\n\n", "\x0b", " "][i % 5] for i in range(3000))
    (tmp_path / "a.txt").write_text(text, newline="")
    (tmp_path / "b.txt").write_text("one\n\n\nfour", newline="")
    (tmp_path / "c.txt").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {(r.file[-5:], r.line): r.value for r in rows}
    want = {("a.txt", i): v for i, v in enumerate(text.splitlines(), 1)} | {("b.txt", i): v for i, v in enumerate(["one", "", "", "four"], 1)}
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_document_ids_are_kept_and_go_on(spark):
    files = spark.createDataFrame([(f"k{i:03}", i) for i in range(100)] + [("k001", 999)], "file_key string, v int")
    known = spark.createDataFrame([("k005", 41), ("k050", 7)], "file_key string, document_id long")
    got = {r.file_key: r.document_id for r in with_document_ids(files, known).collect()}
    assert got["k005"] == 41 and got["k050"] == 7 and len(got) == 100
    assert [got[k] for k in sorted(got) if k not in ("k005", "k050")] == list(range(42, 140))


def test_a_batch_that_fails_between_commits_goes_on_after_the_last(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"f{i}.md").write_text(f"# T{i}\n\nbody {i}\n")
    (tmp_path / "in" / "x.doc").write_text("no")
    store = Store(spark, str(tmp_path / "s"))
    documents, rejected = Table(store, "documents", DOCUMENTS), Table(store, "rejected", "file_key string, workspace_id long, filename string, error_code string")
    chunks = Table(store, "chunks", "id long, workspace_id long, text string")
    run = lambda: ingest_stream(read_files(spark, str(tmp_path / "in"), 1, streaming=True, files_per_trigger=4), documents, chunks, str(tmp_path / "check"), None, rejected).awaitTermination()
    whole, calls = Store.commit, []

    def breaks(self, changes, *args, **kwargs):
        calls.append(sorted(changes))
        if len(calls) == 2:
            raise OSError("lost")
        return whole(self, changes, *args, **kwargs)

    monkeypatch.setattr(stores.Store, "commit", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    waiting = {r.file_key: (r.document_id, r.status, r.updated_at) for r in documents.read().collect()}
    assert {s for _, s, _ in waiting.values()} == {"PENDING"} and chunks.read().count() == 0 and store.mark("ingest") == 0
    run()
    assert calls[0] in (["documents"], ["documents", "rejected"]) and calls[2] == ["chunks", "documents"], calls
    rows = documents.read().collect()
    assert len(rows) == 5 == chunks.read().count() and {r.status for r in rows} == {"COMPLETED"} and rejected.read().count() == 1
    assert all(waiting.get(r.file_key, (r.document_id,))[0] == r.document_id for r in rows) and sorted(r.document_id for r in rows) == [1, 2, 3, 4, 5]
    assert store.mark("ingest") == 5 and store.state()[0] == len(calls) - 1


def test_a_finished_batch_that_comes_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.md").write_text("# T\n\nbody\n")
    store = Store(spark, str(tmp_path / "s"))
    documents, chunks = Table(store, "documents", DOCUMENTS), Table(store, "chunks", "id long, workspace_id long, text string")
    for check in ("one", "two"):  # a lost checkpoint: Spark runs batch 0 again
        ingest_stream(read_files(spark, str(tmp_path / "in"), 1, streaming=True), documents, chunks, str(tmp_path / check)).awaitTermination()
    assert store.state()[0] == 3 and documents.read().count() == 1
    other = Table(Store(spark, str(tmp_path / "t")), "x", "id long, workspace_id long")
    with pytest.raises(ValueError, match="several stores"):
        upsert_together([(documents, documents.read(), "document_id"), (other, other.read(), "id")])
